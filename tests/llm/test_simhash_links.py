"""SimHash components on tables that hold links, against brute force, rows without ids and repeated ids included."""

import random

from lettermill.llm import simhash
from tests.llm.test_operators import docs_of, plain_fingerprint, roots


def test_links_of_near_texts(spark):
    rng = random.Random(12)
    rows = []
    for g in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(600)]
        for _ in range(8):
            some = list(words)
            for _ in range(rng.randint(0, 6)):
                some[rng.randrange(len(some))] = f"x{rng.randrange(90)}"
            rows.append((None if rng.random() < 0.3 else rng.choice([7, 1000 * g + len(rows)]), " ".join(some)))
    prints = [plain_fingerprint(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert sum(prints[a] != prints[b] for a, b in links) > 20
    root = roots(range(len(rows)), links)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[root[n]] = min(i, least.get(root[n], i))
    want = sorted(((i is None, i or 0), f"{prints[n]:016x}", least.get(root[n], -1)) for n, (i, _) in enumerate(rows))
    got = simhash.simhash_components(docs_of(spark, rows)).collect()
    assert sorted(((r["id"] is None, r["id"] or 0), f"{r['fp'] % (1 << 64):016x}", -1 if r["component_id"] is None else r["component_id"]) for r in got) == want
