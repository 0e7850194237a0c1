"""The table of units inside a task, and texts that pass a worker once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm import token_alignment, token_output
from llm.byte_bpe import Vocabulary, with_tokens
from llm.common import UnitTable, byte_level_encoder, byte_level_entries, distinct_units, units, with_source
from llm.token_output import pack, unpack


def _counted(seen: list[str], times: int = 1):
    def encode(new):
        seen.extend(new)
        return np.fromiter((ord(c) for u in new for c in u * times), np.uint32), np.array([len(u) * times for u in new], np.int64)

    return encode


def test_frequent_units_are_encoded_once():
    first, second = [], []
    known = UnitTable(_counted(first), _counted(second, 2), size=100)
    hot = [f"h{k}" for k in range(30)]
    for round_ in range(40):
        once = [f"o{round_}-{k}" for k in range(20)]
        numbers = known.numbers([hot, once, [], hot])
        for k, times in ((0, 1), (1, 2)):
            ids, counts = known.ids(numbers, k)
            wanted = [*hot, *once, *hot]
            assert "".join(map(chr, ids)) == "".join(u * times for u in wanted)
            assert counts.tolist() == [len(u) * times for u in wanted]
        assert len(known.known) <= 100 + 50
    # half of the table went several times, and no frequent unit with it
    assert len(first) == len(set(first)) == 30 + 40 * 20 and first == second


def test_long_units_do_not_stay():
    known = UnitTable(_counted([]), size=10)
    for k in range(50):
        texts = [["a", "x" * (100 + k)], [], ["b"]]
        assert ["".join(map(chr, x)) for x in known.ids_of(texts)] == ["a" + "x" * (100 + k), "", "b"]
        assert max(map(len, known.known)) == 1 and len(known.values[0]) < 16 * 10 + 300
    assert known.ids_of([]) == [] and known.ids_of([[]])[0].tolist() == []


def test_a_failing_encoder_leaves_nothing_behind():
    def fails(new):
        raise RuntimeError("no ids")

    known = UnitTable(_counted([]))
    encode = known.encoders
    known.ids_of([["a"]])
    known.encoders = (fails,)
    with pytest.raises(RuntimeError):
        known.ids_of([["a", "b"]])
    known.encoders = encode
    assert ["".join(map(chr, x)) for x in known.ids_of([["b", "a"]])] == ["ba"]


def test_rows_of_units_are_cut_as_each_alone():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = "One two,\n\n three \t four\x0bfive \x1csix  don't DON'T 1234 \u3000wide <|endoftext|> é\U0001f600 end "
    new = list(dict.fromkeys([*units(text), *units(text[3:] + "x"), "alone", " "]))
    ids, counts = byte_level_encoder(tokenizer, np.array([len(b) for b in byte_level_entries(tokenizer)]))(new)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == [tokenizer.encode(u, add_special_tokens=False).ids for u in new]


def test_both_tokenizers_share_the_units():
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    coder = token_alignment.Coder(token_alignment.Tokenizers.load(*paths))
    text = "some words and some more words"
    (a, a_starts), (b, b_starts) = coder.ids([text, "", "a\\b c\rd", text])
    assert len(coder.known.known) >= len(set(units(" " + text)))
    for x, starts, spelled in ((a, a_starts, coder.first_bytes), (b, b_starts, coder.second_bytes)):
        words = [b"".join(spelled[i] for i in x[lo:hi]) for lo, hi in zip(starts, starts[1:])]
        assert words == [f" {text}".encode(), b"", b" a\\b c\rd", f" {text}".encode()]
    coder.known.encoders = (None, None)  # a second time nothing is encoded
    assert np.array_equal(coder.ids([text])[0][0], a[: a_starts[1]])


def test_packed_words_are_the_greedy_ones():
    rng = np.random.default_rng(2)
    for n, high in ((1, 2), (59, 2), (61, 2), (500, 3), (500, 60_000), (500, 1 << 40)):
        values = rng.integers(0, high, n).astype(np.uint64)
        words, escapes = pack(values)
        at, count = 0, 0
        while at < n:
            at += next(per for per in (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1) if all(int(v) < 1 << 60 // per for v in values[at : at + per]))
            count += 1
        assert len(words) == count and not len(escapes) and np.array_equal(unpack(words, escapes, n), values)


def test_a_text_passes_a_worker_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    assert with_source(docs, "text", "_whole_text") == (docs, "text")
    other, name = with_source(docs.select("doc_id", F.struct("text").alias("s")), "s.text", "_whole_text")
    assert name == "_whole_text" and other.columns == ["doc_id", "s", "_whole_text"]
    vocabulary = Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    without = with_tokens(docs, vocabulary, digests=True, keep_text=False)
    assert without.columns == ["doc_id", "tokens"]
    assert sorted(map(tuple, without.collect())) == sorted(map(tuple, with_tokens(docs, vocabulary, digests=True).drop("text").collect()))


def test_a_unit_is_looked_up_once_in_a_column():
    texts = ["", None, "à la\xa0x  y", "a\u3000 b\x85 c a", " ", "\n\n", "x <|endoftext|> y", "\x1c a\x1c b", "É\n\té  \r\n x", "y y y", ""]
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        known = token_output._table(file.read())
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode, asked = known.numbers, []
    known.numbers = lambda lists: encode([asked.append(x) or x for x in lists])
    for column in (pa.array(texts), pa.array(texts * 50).slice(3, 300), pa.array(texts, pa.large_string()).slice(0, 2), pa.array([], pa.string())):
        different, places, begins = distinct_units(column)
        plain = [t or "" for t in column.to_pylist()]
        assert ["".join(different[i] for i in places[a:b]) for a, b in zip(begins, begins[1:])] == plain
        assert len(set(different)) == len(different) and len(begins) == len(column) + 1
        ids, bounds = token_output._encoded(known, column)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in plain]
        assert all(len(x) == len(set(x)) for x in asked)
    assert distinct_units(pa.array(["a\xa0b c", "\u2003 d"]))[0] == ["a\xa0b", " c", "\u2003 d"]
