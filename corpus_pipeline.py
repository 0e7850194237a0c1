"""The corpus pipeline: five stages over ``documents``, each an operator of :mod:`llm` with production parameters.

Every stage takes (spark, docs, sf_dir) and all rows its predecessor kept; all
but the last return the columns of ``docs``. NULL ids and texts, repeated rows,
empty tables and extra columns pass through as the operators' docstrings say.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.byte_bpe import Vocabulary, with_tokens
from llm.common import free_name, stage, table
from llm.decontaminate import with_leaks
from llm.line_dedup import dedup_lines
from llm.minhash_dedup import with_components
from llm.quality_rules import fit_quality, quality_rules


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep; the trees learn from the labelled ones among ``docs``."""
    out = free_name(docs, "quality_rules")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs, model).where(F.col(f"{out}.kept")).select(*_columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines found in ten or more; ``n_chars`` follows the text. A text that is left without lines is empty."""
    out = free_name(docs, "line_dedup")
    new = F.col(f"{out}.text")
    changed = {"text": new, "n_chars": F.length(new).cast("bigint")}
    return dedup_lines(docs).select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word similarity 0.8: the one with the smallest id.

    Rows that repeat an id inside a group leave one row; a group without any id
    leaves one row. Documents without words are in no group and stay.
    """
    out = free_name(docs, "near_dup")
    found = with_components(docs, width=5, percent=80)
    kept = found.where(F.col(f"{out}.kept"))
    component = free_name(found, "_component")
    single = kept.where(F.col(f"{out}.component").isNotNull()).withColumn(component, F.col(f"{out}.component")).dropDuplicates([component])
    alone = kept.where(F.col(f"{out}.component").isNull())
    return single.select(*_columns(docs)).unionAll(alone.select(*_columns(docs)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    out = free_name(docs, "leaks")
    return with_leaks(docs, table(spark, sf_dir, "benchmark")).where(F.size(out) == 0).select(*_columns(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document that is left."""
    import public_tokenizers

    vocabulary = Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return with_tokens(docs.select("doc_id", "text"), vocabulary, digests=True, keep_text=False).select("doc_id", "tokens.*")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("minhash_dedup", near_duplicates),
    ("decontaminate", decontaminate),
    ("byte_bpe", tokens),
]

#: The trees of the first stage and the tokenizer of the last one are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored in the shared folder before the next reads it."""
    *first, (_, last) = STAGES
    docs = reduce(lambda df, named: stage(named[1](spark, df, sf_dir)), first, table(spark, sf_dir, "documents"))
    return last(spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
