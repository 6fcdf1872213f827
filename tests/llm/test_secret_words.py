"""Secrets behind key names and URL paths."""

import random

from lettermill.llm import secret_scan
from tests.llm.test_operators import docs_of


def test_secret_behind_words(spark):
    rng = random.Random(6)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts, secrets = {}, {}
    for i, lead in enumerate(["aws_secret_access_key=", "stripe_live_private_key=", "//host/users/data/export/", "AWS_SECRET_ACCESS_KEY=", "see example_service_api_key=", "https://example-bucket/myData/"]):
        for k in range(10):
            secrets[10 * i + k] = "".join(rng.choice(signs) for _ in range(40))
            texts[10 * i + k] = f"🙂 {lead}{secrets[10 * i + k]} end"
    plain = {1000: "//host/users/data/export/reports/2024/summary/page3", 1001: "EXAMPLEq8Zr1Tn5Kw2Yp7Ls4Xv9Bm3Cd6F", 1002: "some_long_setting_name=abcdefghijklmnopqrstuvwx0123456789", 1003: "my_test_secret_name=placeholder1234567890ABCDEFGHIJ"}
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs_of(spark, [*texts.items(), *plain.items()])).collect()}
    for i, secret in secrets.items():
        shown = clean[i].replace("[SECRET]", "|").removesuffix(" end")
        left = max((n for n in range(41) if secret[:n] and secret[:n] in shown), default=0) + max((n for n in range(41) if n and shown.endswith(secret[-n:])), default=0)
        assert left == 0 or left <= 16 and "[SECRET]" in clean[i], clean[i]
    assert sum("[SECRET] end" in clean[i] for i in secrets) >= 0.8 * len(secrets)
    assert all(clean[i] == t for i, t in plain.items())
