"""Token alignment, periodic runs and packing against brute force on small tables and on whole documents."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from llm import packing, queries
from llm.byte_bpe import byte_characters
from llm.packing import Packing, evolve, least_sequences, pack, token_pieces, whole_sequences
from llm.periodic_runs import find_runs, stretches, with_runs
from llm.token_alignment import Tokenizers, align, common_ends

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, id string, `group` string, groups string, tokens bigint, sequence_id string, offset string, periodic string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    again = prose(3, 9)
    return [
        (1, prose(1, 60)),
        (1, prose(1, 60)),
        (None, prose(1, 60)),
        (2, None),
        (3, ""),
        (4, " \t\n\x0b "),
        (5, "one"),
        (6, " leading  and trailing  \n\n"),
        (7, "a<|endoftext|>b <s> <0x41> ▁ é ﬁ 　x \x1c y z"),
        (8, "a ▁ b"),
        (9, " ".join([again] * 7)),
        (10, prose(4, 30) + " " + " ".join([again] * 4) + " " + prose(5, 30)),
        (11, " ".join(["same"] * 50 + ["other"] + ["same"] * 40)),
        (12, "x" * 30_000),
        (13, "éç\U0001f600 " * 40 + "don't DON'T 123456"),
        (14, prose(6, 9000)),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "x", "x", 1, "x", "x", "x") for i, t in texts], SCHEMA)


@lru_cache
def tokenizers() -> Tokenizers:
    return Tokenizers.load(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def aligned_by_hand(texts):
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = {c: b for b, c in enumerate(byte_characters())}

    def first_bytes(i):
        return bytes(byte_of[c] for c in first.id_to_token(i))

    def second_bytes(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    found, counts = [], Counter()
    for doc_id, text in texts:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if b"".join(map(first_bytes, a)) != whole or b"".join(map(second_bytes, b)) != whole:
            a, b = [], []
        ends_a = np.cumsum([len(first_bytes(i)) for i in a]).tolist()
        ends_b = np.cumsum([len(second_bytes(i)) for i in b]).tolist()
        groups, links, at_a, at_b = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a[at_a:to_a])) + "|" + ",".join(map(str, b[at_b:to_b])))
            links.append((a[to_a - 1], b[to_b - 1]))
            at_a, at_b = to_a, to_b
        counts.update(links)
        found.append((doc_id, len(a), len(b), ";".join(groups), links))
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [
        (d, n_a, n_b, len(links), groups, len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links))
        for d, n_a, n_b, groups, links in found
    ]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_alignment_of_odd_texts(docs, texts):
    found = align(docs, tokenizers()).select("id", "n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum")
    assert ordered(map(tuple, found.collect())) == ordered(aligned_by_hand(texts))


def test_alignment_of_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(*r[:4], hashlib.sha256(r[4].encode()).hexdigest() if r[4] else "", *r[5:]) for r in aligned_by_hand(rows)]
    columns = "doc_id n_a n_b n_groups groups_sha256 n_links n_best count_sum".split()
    assert ordered(map(tuple, queries.op11_token_alignment(spark, SF).select(columns).collect())) == ordered(want)


def test_alignment_over_several_blocks(docs, texts, monkeypatch):
    monkeypatch.setattr("llm.token_alignment.BLOCK_BYTES", 300)
    found = align(docs.repartition(3), tokenizers()).select("id", "n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum")
    assert ordered(map(tuple, found.collect())) == ordered(aligned_by_hand(texts))


def test_common_ends_equal_set_intersection():
    rng = random.Random(5)
    for _ in range(300):
        a, b, starts_a, starts_b, base = [], [], [0], [0], 0
        for _ in range(rng.randint(1, 4)):
            size = rng.choice([0, 3, 50, 400])
            for out, starts in ((a, starts_a), (b, starts_b)):
                out += sorted(base + 1 + x for x in rng.sample(range(size), rng.randint(0, size)))
                starts.append(len(out))
            base += size
        at_a, at_b = common_ends(np.array(a, int), np.array(starts_a), np.array(b, int), np.array(starts_b))
        want = sorted(set(a) & set(b))
        assert [a[k] for k in at_a] == want and [b[k] for k in at_b] == want


def test_alignment_of_nothing(docs):
    assert align(docs.limit(0), tokenizers()).collect() == []
    assert [r[1:] for r in align(docs.where("doc_id in (2, 3)"), tokenizers()).collect()] == [(0, 0, 0, "", 0, 0, 0)] * 2


def runs_by_hand(words, min_length=24, min_periods=3):
    n, found = len(words), []
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(min_length, min_periods * q):
                own = words[i : i + size]
                if all(own[r:] != own[:-r] for r in range(1, q)):
                    found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def described_by_hand(words):
    runs = runs_by_hand(words)
    dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
    most = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    return runs, most, b" ".join(w for k, w in enumerate(words) if k not in dropped)


@pytest.mark.parametrize(("min_length", "min_periods"), [(1, 2), (8, 3), (24, 3)])
def test_runs_equal_brute_force(min_length, min_periods):
    rng = random.Random(min_length)
    for _ in range(250):
        words, n, kinds = [], rng.randint(0, 110), rng.choice([1, 2, 3, 6])
        while len(words) < n:
            root = [rng.randrange(kinds) for _ in range(rng.randint(1, 9))]
            words += root * rng.choice([1, 1, 3, 6])
        words = words[:n]
        assert [tuple(r) for r in find_runs(np.array(words, int), min_length, min_periods).tolist()] == runs_by_hand(words, min_length, min_periods)
        if min_length == 24:
            inside = [(s + b, size, q) for b, e in stretches(np.array(words, int), np.array([0, n])).tolist() for s, size, q in find_runs(np.array(words[b:e], int)).tolist()]
            assert sorted(inside, key=lambda r: (r[0], r[2])) == runs_by_hand(words)


def test_runs_of_odd_texts(docs, texts):
    found = with_runs(docs)
    assert found.columns == [*docs.columns, "_periodic"]
    rows = found.select("doc_id", "_periodic.*").collect()
    want = []
    for doc_id, text in texts:
        words = (text or "").encode().split()
        runs, most, collapsed = described_by_hand(words)
        want.append((doc_id, len(words), runs, most, collapsed.decode()))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], tuple(r.most) if r.most else None, r.collapsed) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {d: len(runs) for d, _, runs, _, _ in want if d in (9, 10, 11)} == {9: 1, 10: 1, 11: 2}
    assert with_runs(docs.limit(0)).collect() == []


def test_runs_of_documents_with_planted_repeats(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want, planted = [], 0
    for doc_id, text in rows:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
            planted += 1
        runs, most, collapsed = described_by_hand(words)
        lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        start, size, q = most or (None, None, None)
        milli = 1000 * size // q if most else None
        want.append((doc_id, len(runs), start, size, q, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()))
    columns = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert ordered(map(tuple, queries.op12_periodic_runs(spark, SF).select(columns).collect())) == ordered(want)
    assert planted > 5


def test_suffix_trees_of_a_long_text_take_linear_work():
    words = np.tile(np.arange(4000), 15)
    assert find_runs(words).tolist() == [[0, 60_000, 4000]]


def packed_whole(rows, size):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def word_definition() -> str:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def pieces_by_hand(texts, size):
    tokenizer = Tokenizer.from_str(word_definition())
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), size)):
            yield doc_id, k, at, ids[at : at + size]


def test_pieces_and_sequences_of_odd_texts(docs, texts):
    size = 256
    found = token_pieces(docs, word_definition(), 1, size)
    got = [(r.id, r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in found.collect()]
    want = list(pieces_by_hand(texts, size))
    assert ordered(got) == ordered(want)
    whole = pack(found.withColumn("offset", found.start), size=size)
    assert whole.columns == ["id", "piece", "start", "length", "ids", "offset", "sequence_id", "_offset"]
    sequences = whole_sequences(whole, offset="_offset").collect()
    assert Counter(i for s in sequences for i in np.frombuffer(s.ids, "<u4").tolist()) == Counter(i for *_, ids in want for i in ids)
    assert all(len(s.ids) <= 4 * size for s in sequences) and sum(s.n_pieces for s in sequences) == len(want)


def test_packing_of_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op13_packing(spark, SF).collect()
    want = [(d, k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, k, at, ids in pieces_by_hand(rows, 4096)]
    assert ordered((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == ordered(want)
    assert packed_whole(got, 4096) == least_sequences(np.array([r.length for r in got]), 4096)


def test_packing_over_several_shards_and_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 40)
    rng = random.Random(7)
    rows = [(k % 50, rng.choice([10, 64, rng.randint(1, 100), rng.randint(1, 30)])) for k in range(600)] + [(1, 100), (1, 100), (None, None), (2, 0)]
    packed = pack(spark.createDataFrame(rows, "doc_id int, length int"), size=100, epochs=2).collect()
    placed = [r for r in packed if r.sequence_id is not None]
    assert Counter((r.doc_id, r.length) for r in packed) == Counter(rows) and len(packed) - len(placed) == 2
    lengths = np.array([n for _, n in rows if n])
    assert packed_whole(placed, 100) <= 1.02 * least_sequences(lengths, 100) + 1
    assert pack(spark.createDataFrame([], "length int")).collect() == []
    with pytest.raises(ValueError, match="does not fit"):
        pack(spark.createDataFrame([(5,)], "length int"), size=4)


def test_generations_do_not_lose_pieces_and_improve_on_best_fit():
    rng = np.random.default_rng(0)
    lengths = -np.sort(-rng.integers(800, 3000, 2000))
    founders = evolve(lengths, 4096, [], "a", generations=0)
    bred = evolve(lengths, 4096, evolve(lengths, 4096, founders, "b"), "c")
    for p in bred:
        again = Packing.of(p.places, lengths, 4096)
        assert (again.free == p.free).all() and (p.free >= 0).all() and p.places.min() == 0
    assert bred[0].fitness(4096) > founders[0].fitness(4096)
    assert len(bred[0].free) >= least_sequences(lengths, 4096)


@pytest.mark.parametrize(("lengths", "size", "bound"), [([], 10, 0), ([10, 10], 10, 2), ([6, 6, 6, 4, 4], 10, 3), ([7, 7, 7, 4, 4, 4], 10, 5), ([5, 5, 1], 10, 2), ([1] * 21, 10, 3)])
def test_least_sequences(lengths, size, bound):
    assert least_sequences(np.array(lengths, int), size) == bound
