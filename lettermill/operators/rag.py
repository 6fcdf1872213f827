"""Retrieval for question answering: entities of questions, context mails, prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions import text as X


def dictionary_matcher(names: dict[str, str]) -> Callable[[str], list[tuple[str, str]]]:
    """Finds the names of a bounded dictionary {name: type} in a text, in order of their first place."""

    def match(text: str) -> list[tuple[str, str]]:
        low = text.lower()
        found = sorted((low.find(n.lower()), n, t) for n, t in names.items() if n.lower() in low)
        return [(n, t) for _, n, t in found]

    return match


def extract_entities(texts: DataFrame, extract: Callable[[str], list[tuple[str, str]]]) -> DataFrame:
    """(id, entities, error) of texts (id, text) by any extractor; one that raises gives no entities and its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                try:
                    rows.append((key, [{"name": n, "type": t} for n, t in (extract(text) if text and text.strip() else [])], None))
                except Exception as e:  # noqa: BLE001  a failing extractor is a soft failure
                    rows.append((key, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["id", "entities", "error"])

    return texts.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(run, "id string, entities array<struct<name:string,type:string>>, error string")


#: Letters at the start of a name that find the concepts to hold it against.
GRAM = 3


def rag_context(entities: DataFrame, mails: DataFrame, mentions: DataFrame, concepts: DataFrame, k: int) -> DataFrame:
    """(question, id, rank): for each entity (question, place, name) its newest k mails, each mail at its first entity, k a
    question. Distinct names meet the concepts once, so questions that ask the same share the work; the top k of a name are
    taken before they go back to the questions."""
    names = entities.select("name").distinct()
    # a concept that contains a name also has its first three letters somewhere, so an equal join finds what contains() then verifies
    grams = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c), F.lit(1))), lambda i: F.substring(c, i, n)))))
    known = concepts.select("concept_key", F.col("name").alias("concept"), F.explode(F.array_union(grams(F.col("name")), F.array(F.lit("")))).alias("gram"))
    asked = names.withColumn("gram", F.substring("name", 1, GRAM))
    hit = asked.join(known, "gram").where(F.contains("concept", "name")).select("name", "concept_key").distinct()
    found = hit.join(mentions, "concept_key").select("name", F.col("email_id").alias("id")).distinct().join(mails.select("id", "received"), "id")
    per_name = Window.partitionBy("name").orderBy(F.desc("received"), "id")
    best = found.withColumn("r", F.row_number().over(per_name)).where(F.col("r") <= k)
    asked = entities.join(best, "name").groupBy("question", "id").agg(F.min(F.struct("place", "r")).alias("at"))
    per_question = Window.partitionBy("question").orderBy("at", "id")
    return asked.withColumn("rank", F.row_number().over(per_question)).where(F.col("rank") <= k).select("question", "id", "rank")


def chat_tail(turns: DataFrame, max_turns: int) -> DataFrame:
    """(conv_id, history): the last 2 * max_turns entries in order; entries without role or text drop out after the cut."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    tail = turns.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2 * max_turns).where("role is not null and text is not null")
    lists = tail.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("o"), "role", "text"))).alias("h"))
    return lists.select("conv_id", F.transform("h", lambda x: F.concat(x["role"], F.lit(": "), x["text"])).alias("history"))


NOTHING_FOUND = "No relevant content was found in the knowledge graph."
SYSTEM = "You answer questions about a mail archive. Use only the context below and say so if it is not enough.\n\n=== Context ===\n"


def rag_sources(context: DataFrame, mails: DataFrame) -> DataFrame:
    """(question, sources): id, subject and owner of the context mails, in rank order."""
    rows = context.join(mails.select("id", "subject", "owner"), "id")
    return rows.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "subject", "owner"))).alias("sources"))


def rag_prompt(questions: DataFrame, context: DataFrame, mails: DataFrame) -> DataFrame:
    """(question_id, prompt) of questions (question_id, question): numbered context mails with 500 characters each, then the
    question; a notice where nothing was found."""
    rows = context.join(mails.select("id", "subject", "received", "pst_file", "text"), "id")
    block = F.concat(
        F.lit("--- Hit "), F.col("rank").cast("string"), F.lit(" ---\nSubject: "), F.coalesce("subject", F.lit("")), F.lit("\nDate: "), F.date_format("received", "yyyy-MM-dd"),
        F.lit("\nFile: "), F.coalesce("pst_file", F.lit("")), F.lit("\nContent: "), X.truncate(F.coalesce("text", F.lit("")), X.CONTEXT_CHARS), F.lit("\n\n"),
    )
    blocks = rows.groupBy(F.col("question").alias("question_id")).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("l"))
    text = blocks.select("question_id", F.array_join(F.transform("l", lambda x: x["b"]), "").alias("context"))
    return questions.join(text, "question_id", "left").select("question_id", F.concat(F.lit(SYSTEM), F.coalesce("context", F.lit(NOTHING_FOUND)), F.lit("\nQuestion: "), "question").alias("prompt"))


def k1_prompts(mails: DataFrame) -> DataFrame:
    """Extraction prompts; mails with a blank text have none."""
    return mails.select("id", X.k1_prompt(F.col("text")).alias("prompt")).where("prompt is not null")
