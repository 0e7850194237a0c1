"""The registered queries of the operators: contract columns derived from each operator's own result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from llm.common import F, table
from llm import cotraining, html_extract, secret_scan, toxicity
from llm import quality_rules as quality
from llm.byte_bpe import Vocabulary, with_tokens
from llm.decontaminate import with_leaks
from llm.line_dedup import SPACES, UPPER, dedup_lines
from llm.minhash_dedup import with_components
from llm.packing import pack, token_pieces
from llm.periodic_runs import with_runs
from llm.token_alignment import Tokenizers, align
from llm.token_output import read_tokens, write_tokens


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_extract.with_main_text(pages, html_extract.fit_extractor(pages))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    judged = quality.quality_rules(docs, model)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return judged.select("doc_id", *[f"quality_rules.{c}" for c in names])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_toxicity(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "toxicity.score", "toxicity.predicted")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id",
        "line_dedup.n_lines",
        "line_dedup.n_dropped",
        F.sha2(F.col("line_dedup.text").cast("binary"), 256).alias("kept_sha256"),
    )


def _sql_key(line: str) -> str:
    spaces = " || ".join(f"chr({ord(c)})" for c in SPACES)
    return f"translate(trim({line}, {spaces}), '{UPPER}', '{UPPER.lower()}')"


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_components(docs, width=4, percent=80)
    return found.select("doc_id", *[f"near_dup.{c}" for c in ("n_shingles", "component_id", "kept")])


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_tokens(docs, vocabulary, digests=True, keep_text=False).select("doc_id", "tokens.*")


def op7_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    scored = cotraining.with_quality(docs, cotraining.fit_cotraining(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "quality.*")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate of every document, with its score; the candidate itself is not shown."""
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "position", "place", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it contains."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("leaks"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    manifest, folder = write_tokens(table(spark, sf_dir, "documents"), definition, end_id=2)
    return read_tokens(spark, manifest, folder).withColumnRenamed("id", "doc_id")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    both = Tokenizers.load(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    found = align(table(spark, sf_dir, "documents"), both, digests=True)
    return found.withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})


def planted_repeats(docs: DataFrame) -> DataFrame:
    """The contract's texts of the run query: where the id's CRC-32 is a multiple of ten, a part of the words repeats."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.when(F.size("w") > 0, F.size("w")))
    rows = rows.withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    copies = F.ceil(rest / F.col("p")).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), copies)), F.lit(1), rest)
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), repeated), " ")
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    runs, most = F.col("periodic.runs"), F.col("periodic.most")
    lines = F.transform(runs, lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    return with_runs(docs).select(
        "doc_id",
        F.size(runs).cast("bigint").alias("n_runs"),
        "periodic.most.*",
        F.floor(1000 * most["length"] / most["period"]).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size(runs) > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("periodic.collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        definition = file.read()
    pieces = token_pieces(table(spark, sf_dir, "documents"), definition, end_id=1)
    digests = pieces.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(digests)


LINE_DEDUP_SQL = f"""
WITH split AS (
    SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), line AS (
    SELECT rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM split
), keyed AS (
    SELECT rid, i, line, {_sql_key("line")} AS key FROM line
), frequent AS (
    SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10
), marked AS (
    SELECT rid, i, line, key IN (SELECT key FROM frequent) AS dropped FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked JOIN split USING (rid) GROUP BY rid, doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extract": op1_html_extract,
        "op2_quality_rules": op2_quality_rules,
        "op3_toxicity": op3_toxicity,
        "op4_line_dedup": op4_line_dedup,
        "op5_minhash_dedup": op5_minhash_dedup,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_cotraining": op7_cotraining,
        "op8_secret_scan": op8_secret_scan,
        "op9_decontaminate": op9_decontaminate,
        "op10_token_output": op10_token_output,
        "op11_token_alignment": op11_token_alignment,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_packing": op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": LINE_DEDUP_SQL}
