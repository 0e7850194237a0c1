"""Quality rules: base rules on word counts, and boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled documents, flattened into
node arrays, and score all documents inside Arrow batches. Symbols, repeated
lines, repeated words and shouting can only lower a score, whatever the sample
says (monotonic constraints).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from llm import trees
from llm.common import F, chunks, free_name, hashed_words, mixed, sampled_labels, texts_of, with_source

#: Labelled documents that the trees are fitted on, at most.
SAMPLE_ROWS = 8_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = (
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share",
    "digit_share", "punctuation_share", "lone_share", "shouted_share", "distinct_share", "words_per_line",
)
MONOTONE = {STATISTICS.index(s): -1 for s in ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "shouted_share")}

_COUNTED = {"symbols": b"#*$%&|<>", "upper": bytes(range(65, 91)), "digits": bytes(range(48, 58)), "punctuation": b".,;:!?"}
_OTHER = {kind: bytes(sorted(set(range(256)) - set(chars))) for kind, chars in _COUNTED.items()}
_CONTINUATION = bytes(range(0x80, 0xC0))
_LONE = re.compile(rb"[^0-9A-Za-z\x80-\xff]+")
_SHOUTED = re.compile(rb"[^a-z]*[A-Z][^a-z]*[!?][^a-z]*")


def _count(text: bytes, kind: str) -> int:
    return len(text.translate(None, _OTHER[kind]))


def repeated_words(hashes: np.ndarray, starts: np.ndarray, window: int = 5) -> np.ndarray:
    """Words of each document that lie in a window found twice or more in the same document."""
    n, documents = len(hashes), len(starts) - 1
    if n < window:
        return np.zeros(documents, np.int64)
    owner = np.repeat(np.arange(documents, dtype=np.uint64), np.diff(starts))
    first = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    if not len(first):
        return np.zeros(documents, np.int64)
    with np.errstate(over="ignore"):
        key = mixed(owner[first] + np.uint64(1))
        for k in range(window):
            key = mixed(key + hashes[first + k])
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, first[again], 1)
    np.add.at(covered, first[again] + window, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:n]) > 0)])
    return inside[starts[1:]] - inside[starts[:-1]]


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (long) and statistics (double) of whole texts, one row each."""
    split = [t.split() for t in texts]  # bytes split at exactly \x20 and \x09-\x0D
    hashes, starts = hashed_words(split)
    repeats = repeated_words(hashes, starts)
    counts = np.zeros((len(texts), len(COUNTS)), np.int64)
    shares = np.zeros((len(texts), len(STATISTICS)))
    for i, (text, words) in enumerate(zip(texts, split)):
        n = len(words)
        seen: set[bytes] = set()
        dups = n_lines = 0
        for line in text.split(b"\n"):
            if line.strip():
                n_lines += 1
                dups += line in seen
                seen.add(line)
        chars = sum(map(len, words)) - (len(text) - len(text.translate(None, _CONTINUATION)))
        symbols = _count(text, "symbols")
        counts[i] = n, chars, symbols, dups, repeats[i]
        different = set(words)
        # over different words first: a text repeats most of them
        lone = {w for w in different if _LONE.fullmatch(w)}
        shouted = {w for w in different if _SHOUTED.fullmatch(w)}
        all_words, all_chars = max(n, 1), max(chars, 1)
        shares[i] = (
            np.log1p(n), chars / all_words, symbols / all_chars, dups / max(n_lines, 1), repeats[i] / all_words,
            _count(text, "upper") / all_chars, _count(text, "digits") / all_chars, _count(text, "punctuation") / all_chars,
            sum(w in lone for w in words) / all_words if lone else 0.0,
            sum(w in shouted for w in words) / all_words if shouted else 0.0,
            len(different) / all_words, n / max(n_lines, 1),
        )
    return counts, shares


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, column: str = "quality") -> trees.Trees:
    """Boosted trees from at most ``sample_rows`` labelled documents (their statistics, never their texts, reach the driver).

    Without usable labels the model keeps everything.
    """
    # the sample has a bounded number of rows of two numbers, so it may be broadcast
    chosen = F.broadcast(sampled_labels(labels, column, sample_rows))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "label", "text")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            _, shares = statistics(texts_of(batch.column("text")))
            rows = pa.array(list(shares), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), rows], ["doc_id", "label", "x"])

    sample = (
        texts.mapInArrow(measured, "doc_id bigint, label int, x array<double>")
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x"))
        .orderBy("doc_id").toPandas()
    )
    if sample.empty:
        return trees.constant(0.999)
    return trees.fit(np.stack(sample["x"].to_numpy()), sample["label"].to_numpy(float), monotone=MONOTONE)


def quality_rules(
    docs: DataFrame,
    model: trees.Trees,
    text: str = "text",
    least_words: int = 10,
    most_repeated: int = 20,
    threshold: float = 0.5,
    out: str = "quality_rules",
) -> DataFrame:
    """``docs`` with a struct column ``out`` added: the five counts, ``base_failed``, ``score``, ``kept``.

    A NULL text counts as empty: all counts 0, so the base rule fails. Rows with
    NULL or repeated ids are judged each by its own text; an empty table gives an
    empty result. Other columns pass unchanged; ``out`` gets underscores in front
    if the name is taken.
    """
    out = free_name(docs, out)
    fields = ", ".join(f"{c}: bigint" for c in COUNTS)
    kind = f"struct<{fields}, base_failed: boolean, score: double, kept: boolean>"
    source, whole = with_source(docs, text, "_whole_text")
    others = docs.columns
    schema = docs.withColumn(out, F.lit(None).cast(kind)).schema

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, whole):
            counts, shares = statistics(texts_of(batch.column(whole)))
            n_words, repeats = counts[:, 0], counts[:, 4]
            failed = (n_words < least_words) | (100 * repeats > most_repeated * n_words)
            score = model.probability(shares)
            columns = [pa.array(counts[:, k]) for k in range(len(COUNTS))]
            columns += [pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
            verdict = pa.StructArray.from_arrays(columns, [*COUNTS, "base_failed", "score", "kept"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), verdict], [*others, out])

    return source.mapInArrow(judged, schema)
