"""Secret scan: candidates in texts, scored by a random forest. DataFrame and ML functions only.

A candidate is a run of 12 or more token characters that holds a digit, changes between cases or
has a value assigned to it. Its features are its length, entropy-like counts
of character transitions, how much of it a dictionary of corpus words covers,
its path (the document's source) and the words beside it. The forest is trained
on labelled findings and removes what only looks like a secret.

No table of labelled findings is given, so :func:`labelled_findings` makes one
from a bounded sample of the candidates themselves: assigned to a name of a
secret, or in an issuer's published key format: 1; else 0.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame

from llm.common import F, stage

#: Labelled findings of each label that the forest is fitted on, at most.
SAMPLE_FINDINGS = 4_000
#: Words of the dictionary, at most: the size of a feature's vocabulary. They are counted in all documents.
DICTIONARY_WORDS = 5_000

RUN = r"[A-Za-z0-9+/_\-]{12,}={0,2}"
#: Names that secrets are assigned to, names that announce harmless digests, issuers' key formats.
SECRET_NAMES = "passw|passwd|pwd|secret|token|api_?key|apikey|access_?key|auth|credential|private_?key|bearer"
HARMLESS_NAMES = "commit|sha1|sha256|md5|checksum|digest|uuid|guid|revision|etag|hash|version|isbn"
KEY_FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|AIza[0-9A-Za-z_\-]{35}|xox[baprs]-[0-9A-Za-z\-]{10,}|sk_live_[0-9A-Za-z]{16,})$"
TEST_PATHS = "test|example|sample|fixture|mock|doc"

FEATURES = (
    "length", "digit_share", "upper_share", "lower_share", "other_share", "kind_changes", "distinct_share", "hex_only",
    "vowel_share", "longest_letters", "repeat_pairs", "covered", "assigned", "quoted", "secret_near", "harmless_near", "path_test",
)


def _count(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)).cast("double")


def candidates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(doc_id, path, position, place, word, own, candidate, before, after): one row per candidate.

    ``position`` counts words before it, ``place`` characters of its word before it, which ``own`` holds. Every run of a word is a
    candidate if it holds a digit or a change of case, or if = or : stands right before it, also in front of a quote. NULL and empty texts
    have none. Repeated rows repeat their candidates.
    """
    rows = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"), F.col(path).cast("string").alias("path"),
        F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+").alias("words"),
    )
    # a letter-only word of one case that assigns nothing has no candidate: most words end at the length test
    places = F.filter(
        F.sequence(F.lit(0), F.size("words") - 1),
        lambda i: (F.length(F.col("words")[i]) >= 12)
        & F.col("words")[i].rlike(r"[0-9=:]|[a-z][A-Z]|[A-Z]{2,}[a-z]")
        & F.col("words")[i].rlike(RUN),
    )

    def beside(i: Column, step: int) -> Column:
        return F.coalesce(F.get(F.col("words"), i + step), F.lit(""))

    # only the words around go with a candidate, not the whole text
    around = F.transform(
        places,
        lambda i: F.struct(
            i.cast("bigint").alias("position"), F.col("words")[i].alias("word"),
            F.concat_ws(" ", beside(i, -3), beside(i, -2), beside(i, -1)).alias("before"), beside(i, 1).alias("after"),
        ),
    )
    found = rows.select("doc_id", "path", F.inline(around))
    found = found.withColumn("_runs", F.regexp_extract_all("word", F.lit(RUN), F.lit(0))).withColumn("_gaps", F.split("word", RUN, -1))
    # what stands in front of run k: the gaps up to it and the runs between them
    sizes = F.transform("_runs", lambda r, k: F.length(r) + F.length(F.col("_gaps")[k]))
    found = found.withColumn("_sizes", sizes).select("*", F.posexplode("_runs").alias("_k", "candidate"))
    place = F.aggregate(F.slice("_sizes", F.lit(1), F.col("_k")), F.lit(0), lambda n, x: n + x) + F.length(F.col("_gaps")[F.col("_k")])
    shaped = F.col("candidate").rlike(r"[0-9]|[a-z][A-Z]|[A-Z]{2,}[a-z]") | F.col("_gaps")[F.col("_k")].rlike("[=:][\"'`]?$")
    return found.where(shaped).withColumn("place", place.cast("bigint")).select(
        "doc_id", "path", "position", "place", "word", F.expr("substring(word, 1, cast(place as int))").alias("own"), "candidate", "before", "after"
    )


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(piece): the most frequent lower-case words of three or more letters in all documents, repeated rows counted once."""
    marked = docs.where(F.col(text).isNotNull()).select(F.xxhash64("doc_id").alias("a"), F.xxhash64(text).alias("b"), text)
    # how often a row comes is found on hashes, so that no text is shuffled
    copies = stage(marked.groupBy("a", "b").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    counted = marked.join(copies, ["a", "b"], "left").select(text, F.coalesce("copies", F.lit(1)).alias("copies"))
    words = counted.select("copies", F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("piece"))
    # the copies of a row hold each word equally often: the quotient is whole
    per_copies = words.groupBy("piece", "copies").agg(F.count(F.lit(1)).alias("n"))
    counts = per_copies.groupBy("piece").agg(F.sum(F.expr("n div copies")).alias("n")).where("n >= 3")
    return counts.orderBy(F.desc("n"), "piece").limit(DICTIONARY_WORDS).select("piece")


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the columns FEATURES. ``words`` is the bounded dictionary, so it may be broadcast."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    # a letter, a digit or another sign each become one sign of a kind; changes between kinds are what is left of repeats
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]+", "\u0001"), "[A-Z]+", "\u0002"), "[0-9]+", "\u0003")
    letters = F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0))
    signs = F.filter(F.split(c, ""), lambda x: x != "")
    # neighbours from the first sign and from the second one on: all pairs, in time linear in the length
    pairs = F.concat(F.regexp_extract_all(c, F.lit(".."), F.lit(0)), F.regexp_extract_all(F.expr("substring(candidate, 2)"), F.lit(".."), F.lit(0)))
    before, word = F.lower("before"), F.lower("word")
    # the name in front of the candidate may be part of its own word
    own = F.lower("own")
    near = F.concat_ws(" ", before, own)
    rows = found.select(
        "*", n.alias("length"), (_count(c, "[0-9]") / n).alias("digit_share"), (_count(c, "[A-Z]") / n).alias("upper_share"),
        (_count(c, "[a-z]") / n).alias("lower_share"), (_count(c, "[^A-Za-z0-9]") / n).alias("other_share"),
        (F.length(kinds) / n).alias("kind_changes"), (F.size(F.array_distinct(signs)) / n).alias("distinct_share"),
        c.rlike("^[0-9a-f]+$").cast("double").alias("hex_only"), (_count(c, "[aeiouyAEIOUY]") / n).alias("vowel_share"),
        (F.aggregate(letters, F.lit(0), lambda m, x: F.greatest(m, F.length(x))) / n).alias("longest_letters"),
        (F.lit(1.0) - F.size(F.array_distinct(pairs)) / F.size(pairs)).alias("repeat_pairs"),
        (own.rlike("[=:]") | before.rlike("[=:]$")).cast("double").alias("assigned"), word.rlike("[\"'`]").cast("double").alias("quoted"),
        near.rlike(SECRET_NAMES).cast("double").alias("secret_near"), near.rlike(HARMLESS_NAMES).cast("double").alias("harmless_near"),
        F.coalesce(F.lower("path").rlike(TEST_PATHS), F.lit(False)).cast("double").alias("path_test"),
    )
    pieces = F.transform(F.regexp_extract_all("candidate", F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0)), F.lower)
    covered = found.select("candidate").distinct().select("candidate", F.explode(pieces).alias("piece")).join(F.broadcast(words), "piece")
    covered = covered.groupBy("candidate").agg(F.sum(F.length("piece")).alias("letters"))
    share = F.coalesce(F.col("letters"), F.lit(0)) / F.col("length")
    return rows.join(covered, "candidate", "left").withColumn("covered", share).drop("letters")


def rule_label() -> Column:
    """The label of a finding by its issuer's format or the name it is assigned to."""
    named = (F.col("secret_near") == 1) & (F.col("assigned") == 1) & (F.col("harmless_near") == 0) & (F.col("digit_share") > 0)
    return F.when(F.col("candidate").rlike(KEY_FORMATS) | named, 1.0).otherwise(0.0)


def labelled_findings(rows: DataFrame, sample: int = SAMPLE_FINDINGS) -> DataFrame:
    """At most ``sample`` different findings of each label, chosen by a hash of the candidate, with all features."""
    # of equal candidates the one with the least features, whatever order they come in
    labelled = rows.withColumn("label", rule_label()).groupBy("candidate", "label").agg(F.min(F.struct(*FEATURES)).alias("f")).select("candidate", "label", "f.*")
    by_hash = [F.xxhash64("candidate"), "candidate"]
    return labelled.where("label = 1").orderBy(*by_hash).limit(sample).unionAll(labelled.where("label = 0").orderBy(*by_hash).limit(sample))


def fit_forest(findings: DataFrame, trees: int = 30, depth: int = 7, seed: int = 11) -> RandomForestClassificationModel | None:
    """A forest on labelled findings; None where they do not hold both labels, since nothing can be told apart then."""
    findings = stage(findings.select("label", *FEATURES))
    if findings.select("label").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(findings)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(rows)


def scan(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, position, place, path, candidate, score, is_secret) of every candidate of ``docs`` (doc_id, text, source).

    NULL, empty and short texts have none, repeated rows have theirs repeated, an empty table gives an empty result; other
    columns are not read. Without labelled findings of both kinds the rule label itself is the score.
    """
    rows = stage(featured(stage(candidates(docs)), stage(dictionary(docs))))
    model = fit_forest(labelled_findings(rows))
    if model is None:
        scored = rows.withColumn("score", rule_label())
    else:
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
        scored = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "position", "place", "path", "candidate", "score", (F.col("score") >= threshold).alias("is_secret"))
