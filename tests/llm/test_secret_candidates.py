"""Candidates of the secret scan against brute force, and words that hold several of them."""

import random
import re
import time

from llm import secret_scan

RUN = re.compile(r"[A-Za-z0-9+/_\-]{12,}={0,2}")
SHAPED = re.compile(r"[0-9]|[a-z][A-Z]|[A-Z]{2,}[a-z]")
SCHEMA = "doc_id bigint, text string, source string, candidate string"
GITHUB = "ghp_" + "a1B2c3D4e5F6" * 3
AWS = "AKIA" + "0123ABCD" * 2


def by_hand(doc_id, text):
    for k, word in enumerate(w for w in re.split(r"[\x20\x09-\x0d]+", text or "")):
        end = 0
        for m in RUN.finditer(word):
            if SHAPED.search(m[0]) or re.search("[=:][\"'`]?$", word[end : m.start()]):
                yield doc_id, k, m.start(), m[0]
            end = m.end()


def test_candidates_equal_brute_force(spark):
    rng = random.Random(4)
    parts = [GITHUB, AWS, "wJalrXUtnFEMI/K7MDENG", "correcthorsebatterystaple", "a.b", "key=", "x:", ":'", '{"a":"', "@host", " ", "\n", "12", "ABCdefGHIjkl", "="]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(300)]
    rows = [(k, t, "s", "x") for k, t in enumerate(texts)] + [(None, texts[0], None, "x"), (7, None, "s", "x"), (7, texts[7], "s", "x")]
    found = secret_scan.candidates(spark.createDataFrame(rows, SCHEMA))
    got = [(r.doc_id, r.position, r.place, r.candidate) for r in found.collect()]
    want = [c for d, t, *_ in rows for c in by_hand(d, t)]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 300
    assert all(r.word.startswith(r.own) and r.word[r.place :].startswith(r.candidate) for r in found.collect())
    assert found.limit(0).collect() == []


def test_every_run_of_a_word(spark):
    texts = [
        f"https://u:{GITHUB}@git-host.example.com/team-repository-01/x",
        f"k={AWS}:wJalrXUtnFEMIK7MDENG",
        f'{{"a":"{AWS}","b":"0123456789abcdef"}}',
        "password=correcthorsebatterystaple",
    ]
    rows = [(k, t, "s", None) for k, t in enumerate(texts)]
    got = {(r.doc_id, r.candidate) for r in secret_scan.candidates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {(0, GITHUB), (1, AWS), (1, "wJalrXUtnFEMIK7MDENG"), (2, AWS), (2, "0123456789abcdef"), (3, "correcthorsebatterystaple")} <= got


def test_a_very_long_word(spark):
    rng = random.Random(1)
    blob = "".join(rng.choices("ABCDefgh0123+/", k=100_000))
    docs = spark.createDataFrame([(1, f"data {blob} end", "s", None), (2, "." + "ab-" * 30_000 + "!", "s", None)], SCHEMA)
    words = spark.createDataFrame([("abc",)], "piece string")
    start = time.perf_counter()
    rows = {r.doc_id: r for r in secret_scan.featured(secret_scan.candidates(docs), words).collect()}
    assert rows[1].length == 100_000 and rows[1].repeat_pairs > 0.99 and time.perf_counter() - start < 30


def test_dictionary_counts_all_documents(spark):
    """A word is counted wherever it stands, not in a sample; a row that comes twice counts once."""
    rows = [(i, f"filler{'x' * (i % 3)} plain words", "a") for i in range(4_000)]
    rows[17] = (17, "rareone rareone rareone", "a")
    rows += [(9_000, "doubled doubled", "a"), (9_000, "doubled doubled", "a"), (9_001, None, "a"), (None, "nobody nobody nobody", "a")]
    for k in range(40):
        rows[100 * k + 50] = (100 * k + 50, f"seldom{chr(97 + k % 26)}{chr(97 + k // 26)} " * 3, "a")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.piece for r in secret_scan.dictionary(docs).collect()}
    assert {"plain", "words", "filler", "rareone", "nobody"} <= found
    assert {f"seldom{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40)} <= found
    assert "doubled" not in found
