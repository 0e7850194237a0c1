"""The operators on small tables: brute-force results, NULLs, empty and repeated rows, clashing names, empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from llm import cotraining, decontaminate, html_extract, quality_rules, queries, secret_scan, toxicity, trees
from llm.byte_bpe import Vocabulary, read_ranks, with_tokens
from llm.components import components
from llm.line_dedup import LineRuns, dedup_lines
from llm.minhash_dedup import with_components
from llm.token_output import file_bytes, pack, read_blocks, read_tokens, unpack, write_tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 60)
    changed = base.split()
    changed[30] = "changed"
    return [
        (1, base, "en", "a", 1, True),
        (2, base.upper(), "en", "a", 2, None),
        (3, " ".join(changed), "en", "a", None, None),
        (None, base, None, None, None, None),
        (4, None, None, None, None, None),
        (4, "", "en", "b", 0, False),
        (5, " \t\n\x0b", "en", "b", 4, False),
        (6, "two words", "en", "b", 9, False),
        (7, "Two  Words", "en", "b", 9, False),
        (8, prose(2, 4000) + "\n<|endoftext|> é　x \x1c y  z", "en", "hot", 5, True),
        (9, prose(2, 4000), "en", "hot", 5, True),
        (9, prose(2, 4000), "en", "hot", 5, True),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- 2: quality rules ----------------------------------------------------------------


def _counts(text: str | None) -> tuple:
    words = _words(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if _words(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(covered)


def test_quality_counts(spark, docs, rows):
    extra = [(10, "a b c d e a b c d e\na b\na b\n#<é>", "en", "a", 1, None)]
    table = docs.unionAll(spark.createDataFrame(extra, SCHEMA))
    found = quality_rules.quality_rules(table, trees.constant(0.9), out="kept").collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"], *r["_kept"][:5]) for r in found))) == sorted(
        map(repr, ((i, t, *_counts(t)) for i, t, *_ in rows + extra))
    )
    for r in found:
        v = r["_kept"]
        assert v["base_failed"] == (v["n_words"] < 10 or 100 * v["n_repeat_words"] > 20 * v["n_words"])
        assert v["kept"] != v["base_failed"]
    assert quality_rules.quality_rules(docs.limit(0), trees.constant(0.9)).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learnt = labels.where("doc_id % 3 <> 0")
    model = quality_rules.fit_quality(docs, learnt)
    judged = quality_rules.quality_rules(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").select("quality", "quality_rules.*").collect()
    right = sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in judged)
    assert right >= 0.95 * len(judged)
    clean = [r for r in judged if r["quality"] == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in clean) >= 0.97 * len(clean)
    none = quality_rules.fit_quality(docs, labels.limit(0))
    assert none.probability(np.zeros((1, len(quality_rules.STATISTICS))))[0] > 0.9


def test_trees_are_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = (x[:, 0] + 0.5 * np.sin(9 * x[:, 1]) + 0.3 * rng.standard_normal(800) > 0.6).astype(float)
    model = trees.fit(x, y, rounds=40, monotone={0: 1, 1: -1})
    grid = np.linspace(0, 1, 50)
    for row in x[:40]:
        line = np.tile(row, (50, 1))
        up, down = line.copy(), line.copy()
        up[:, 0], down[:, 1] = grid, grid
        assert (np.diff(model.margin(up)) >= -1e-9).all() and (np.diff(model.margin(down)) <= 1e-9).all()


# ---- 3: toxicity ----------------------------------------------------------------------


def test_toxicity(spark, docs):
    full = queries.op3_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = full.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert all((r["predicted"] == 1) == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in found)
    clean = [r for r in found if r["held_out"] and not r["toxic"]]
    toxic = [r for r in found if r["held_out"] and r["toxic"]]
    assert sum(r["predicted"] for r in clean) <= 0.05 * len(clean)
    assert sum(r["predicted"] for r in toxic) >= 0.5 * len(toxic)
    model = toxicity.fit_toxicity(docs, labels.limit(0))
    scored = toxicity.with_toxicity(docs, model).collect()
    assert len(scored) == 12 and all(r["toxicity"]["predicted"] == 0 for r in scored)
    assert toxicity.with_toxicity(docs.limit(0), model).count() == 0


def test_toxicity_learns_pairs():
    texts = [f"{prose(k, 30)} {'bad apple' if k % 2 else 'good pear'}" for k in range(200)]
    labels = np.arange(200) % 2
    rows = [np.unique(toxicity.features([t.encode()])[1]) for t in texts]
    model = toxicity.fit_ftrl(rows, labels.astype(float))
    assert len(model.hashes) < 50
    assert ((model.scores([t.encode() for t in texts]) > 0.5) == (labels == 1)).all()


# ---- 4: line dedup ----------------------------------------------------------------------


def test_line_dedup(spark):
    texts = ["Head\nx%d\n tail " % k for k in range(12)] + [None, "", "\n", "head \r\nHEAD\nalone", "tail"] + ["twice\ntwice"] * 5
    table = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc_id bigint, line_dedup string").withColumnRenamed("line_dedup", "text")
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(str.maketrans(UPPER, LOWER))
    counts = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    want = []
    for n, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if counts[key(x)] < 10]
        want.append((n // 2, len(lines), len(lines) - len(kept), "\n".join(kept)))
    found = dedup_lines(table).select("doc_id", "line_dedup.*").collect()
    assert sorted(map(tuple, found)) == sorted(want)
    clash = dedup_lines(table.withColumn("line_dedup", table.doc_id).withColumn("_text_hash", table.doc_id))
    assert clash.columns == ["doc_id", "text", "line_dedup", "_text_hash", "_line_dedup"] and clash.count() == len(texts)
    assert dedup_lines(table.limit(0)).count() == 0


def test_runs_are_levelled(spark):
    runs = LineRuns(min_docs=3, fan_out=2)
    for batch in (["a", "b"], ["a", "c"], ["a", "b"], ["a", "b"], ["a"]):
        runs.add(spark.createDataFrame([(x.encode(),) for x in batch], "key binary"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {bytes(r["key"]) for r in runs.frequent().collect()} == {b"a", b"b"}
    # a key that was frequent already is not counted again
    assert {bytes(r["key"]): r["n_docs"] for r in runs.merged().collect()}[b"a"] == 3


# ---- 5: near duplicates -------------------------------------------------------------------


def _components(rows: list[tuple], width: int) -> tuple[dict, list]:
    sets = []
    for _, text, *_ in rows:
        words = _words((text or "").translate(str.maketrans(UPPER, LOWER)))
        sets.append({tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group, sets


def test_near_duplicates(spark, docs, rows):
    near = []
    base = prose(5, 200).split()
    for k in range(40):  # a chain: neighbours are similar, ends are not
        base[5 * k : 5 * k + 2] = [f"n{k}", f"m{k}"]
        near.append((100 + k, " ".join(base), "en", "a", 1, None))
    every = rows + near
    group, sets = _components(every, 4)
    table = docs.unionAll(spark.createDataFrame(near, SCHEMA)).withColumn("near_dup", docs.lang)
    found = with_components(table, width=4).collect()
    want = []
    for k, row in enumerate(every):
        ids = [r[0] for r, g in zip(every, group) if g == group[k] and r[0] is not None] if sets[k] else [row[0]]
        least = min(ids, default=None)
        want.append((row[0], row[1], len(sets[k]), least, row[0] == least))
    got = [(r["doc_id"], r["text"], r["_near_dup"]["n_shingles"], r["_near_dup"]["component_id"], r["_near_dup"]["kept"]) for r in found]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (5, 5), *((20 + k, 21 + k) for k in range(30))]
    found = components(spark.createDataFrame(links, "u bigint, v bigint")).collect()
    assert dict(map(tuple, found)) == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, **{k: 20 for k in range(20, 51)}}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# ---- 6 and 10: tokens -----------------------------------------------------------------------


def test_byte_bpe(spark, docs, rows):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    vocabulary = Vocabulary.load(path, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    found = with_tokens(docs, vocabulary).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["tokens"]["ids"] == own.encode_ordinary(r["text"] or "")
        assert bytes(r["tokens"]["decoded"]) == (r["text"] or "").encode()
    for r in with_tokens(docs, vocabulary, digests=True).collect():
        ids = np.array(own.encode_ordinary(r["text"] or ""), "<u4")
        assert r["tokens"]["n_tokens"] == len(ids) and r["tokens"]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
    assert with_tokens(docs.limit(0), vocabulary).count() == 0


def test_simple_8b():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 59, 60, 61, 5000):
        for high in (1, 2, 50, 50257, 2**33, 2**60, 2**63):
            values = rng.integers(0, high, n).astype(np.uint64)
            values[::3] = 0
            words, escapes = pack(values)
            assert (unpack(words, escapes, n) == values).all()
    lists = [np.array([5, 2**61, 7], np.uint64), np.array([2], np.uint64)]
    ((before, ids, lengths, values),) = read_blocks(file_bytes([([None, 3], lists)]))
    assert (before, ids, lengths.tolist(), values.tolist()) == (0, [None, 3], [3, 1], [5, 2**61, 7, 2])


def test_token_files(spark, docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        manifest, folder = write_tokens(docs, file.read(), 2)
    own = Tokenizer.from_file(path)
    found = sorted(read_tokens(spark, manifest, folder, with_ids=True).collect(), key=lambda r: r["start"])
    order = [r["id"] for r in found]
    assert order == sorted(order, key=lambda i: (i is not None, i)) and len(found) == len(rows)
    want = Counter((i, tuple(own.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, *_ in rows)
    assert Counter((r["id"], tuple(r["ids"])) for r in found) == want
    at = 0
    for r in found:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    with open(path, encoding="utf-8") as file:
        assert read_tokens(spark, *write_tokens(docs.limit(0), file.read(), 2)).count() == 0


# ---- 7: co-training -------------------------------------------------------------------------


def test_cotraining(spark, docs):
    found = queries.op7_cotraining(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    judged = [r for r in found if r["held_out"]]
    assert sum(r["kept"] == (r["quality"] == 1) for r in judged) >= 0.93 * len(judged)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    none = cotraining.fit_cotraining(docs, labels.limit(0))
    scored = cotraining.with_quality(docs.withColumn("quality", docs.doc_id), none).collect()
    assert len(scored) == 12 and all(abs(r["_quality"]["score"] - 0.5) < 1e-6 for r in scored)
    assert cotraining.with_quality(docs.limit(0), none).count() == 0


# ---- 8: secrets -----------------------------------------------------------------------------


def test_secret_scan(spark, docs):
    found = secret_scan.scan(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source")).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()}
    planted = {i for i, t in texts.items() if re.search(r"\bAKIA[0-9A-Z]{16}\b|\bpassword=[0-9a-f]{18}\b|token = \"[0-9a-f]{40}\"", t or "")}
    assert planted and planted <= {r["doc_id"] for r in found if r["is_secret"]}
    assert not any(r["is_secret"] for r in found if r["candidate"].isdigit())
    for r in found[:50]:
        assert r["candidate"] in _words(texts[r["doc_id"]])[r["position"]]
    assert secret_scan.scan(docs.limit(0)).count() == 0
    few = spark.createDataFrame(
        [(1, "my password=ab12cd34ef56ab78 here", None), (None, 'commit 0123456789abcdef0123 token = "0123456789abcdef01"', "x"), (2, None, "y")],
        "doc_id bigint, text string, source string",
    )
    assert {(r["doc_id"], r["candidate"]) for r in secret_scan.scan(few).collect() if r["is_secret"]} == {(1, "ab12cd34ef56ab78"), (None, "0123456789abcdef01")}


# ---- 9: decontamination ---------------------------------------------------------------------


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(k, prose(900 + k, rng.choice([3, 5, 8, 15, 30, 45, 57, 140]))) for k in range(40)] + [(None, prose(77, 20)), (50, None), (51, "  ")]
    texts = []
    for k in range(120):
        words = prose(2000 + k, rng.randint(0, 300)).split()
        if k % 2:
            piece = (items[k % 41][1] or "").upper().split()
            if k % 4 == 1 and len(piece) > 20:
                piece = piece[2:]
            at = rng.randint(0, len(words))
            words[at:at] = piece
        texts.append((k if k % 10 else None, " ".join(words), k))
    texts += [(500, None, 0), (501, "", 0)]
    index = [decontaminate.shingle_weights(decontaminate.words_of((t or "").encode())) for _, t in items]
    sizes = [len(decontaminate.words_of((t or "").encode())) for _, t in items]
    want = set()
    for i, text, extra in texts:
        words = decontaminate.words_of((text or "").encode())
        for (item, _), shingles, size in zip(items, index, sizes):
            windows = (words[a : a + size] for a in range(max(1, len(words) - size + 1))) if shingles else ()
            if any(100 * decontaminate.similarity(shingles, decontaminate.shingle_weights(w)) >= 80 for w in windows):
                want.add((i, item))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, leaks bigint")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for per_pass in (2000, 17):
        found = decontaminate.with_leaks(docs, benchmark, items_per_pass=per_pass).collect()
        assert len(found) == len(texts)
        got = {(r["doc_id"], leak["item_id"]) for r in found for leak in r["_leaks"]}
        assert want <= got and all(leak["similarity"] >= 0.8 for r in found for leak in r["_leaks"])
    assert decontaminate.with_leaks(docs.limit(0), benchmark).count() == 0
    assert all(r["_leaks"] == [] for r in decontaminate.with_leaks(docs, benchmark.limit(0)).collect())


# ---- 1: HTML ----------------------------------------------------------------------------------


def test_html_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    model = html_extract.fit_extractor(pages, 150)
    import html

    def article(source: str) -> str:
        m = re.search(r"<article>(.*?)</article>", source, re.S)
        blocks = re.split(r"</?(?:p|h1)>", m[1])
        clean = (" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in blocks)
        return " ".join(b for b in clean if b)

    found = html_extract.with_main_text(pages, model).collect()
    assert sum(r["main_text"] == article(r["html"]) for r in found) >= 0.98 * len(found)
    # other layouts of pages that were not learnt
    sources = [r["html"] for r in found]
    right = 0
    other = [html_extract.Page(p) for p in html_extract.training_pages(sources[150:])]
    for page in other:
        kept = page.decode(model.probability(page.features()))
        assert not any(kept[k] and not kept[page.parent[k]] and any(kept[a] for a in _above(page, page.parent[k])) for k in range(1, len(kept)))
        right += page.text(kept) == page.text(page.labels() > 0)
    assert right >= 0.9 * len(other)
    odd = spark.createDataFrame([(1, None, 3), (None, "", 4), (2, "<p>a <b", 5), (2, "<" * 5000 + "<div>" * 300, 6)], "page_id bigint, html string, main_text bigint")
    texts = html_extract.with_main_text(odd, model).collect()
    assert len(texts) == 4 and all(isinstance(r["_main_text"], str) for r in texts) and [r["_main_text"] for r in texts[:2]] == ["", ""]
    assert html_extract.with_main_text(odd.limit(0), model).count() == 0
    assert all(r["_main_text"] == "" for r in html_extract.with_main_text(odd, html_extract.fit_extractor(odd.limit(0))).collect())


def _above(page: html_extract.Page, node: int) -> list[int]:
    found = []
    while node > 0:
        node = page.parent[node]
        found.append(node)
    return found


# ---- pipeline -----------------------------------------------------------------------------------


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    state = docs.withColumn("kept", docs.doc_id).unionAll(spark.createDataFrame([(None,) * 6], docs.withColumn("kept", docs.doc_id).schema))
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r["doc_id"]: r["text"] for r in state.collect()}
        state = stage(spark, state, SF).cache()
        after = state.collect()
        assert state.columns == [*columns, "kept"] and {r["doc_id"] for r in after} <= set(before)
        if name == "minhash_dedup":
            rows = sorted((i, t) for i, t in before.items())
            group, sets = _components(rows, 5)
            first = {}
            for (i, _), g, s in zip(rows, group, sets):
                first.setdefault((g, None) if s else (g, i), i)
            assert sorted(r["doc_id"] for r in after) == sorted(first.values())
    tokens = corpus_pipeline.STAGES[4][1](spark, state, SF).collect()
    assert sorted(r["doc_id"] for r in tokens) == sorted(r["doc_id"] for r in after)
    assert {r["doc_id"]: r["decoded_sha256"] for r in tokens} == {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in after}
    ran = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in ran) == sorted(r["doc_id"] for r in tokens)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
