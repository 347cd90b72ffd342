"""Quality rules by document and by host, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatgrid.llm.common import GAPS, documents, words
from heatgrid.session import cut_lineage

MIN_WORDS = 10
WINDOW_WORDS = 5
MAX_REPEATED = 20  # per cent of words in repeated windows
MAX_HOST_RATE = 0.5  # shrunken failure rate beyond which a host is turned down
WEAKEST, STRONGEST = 1.0, 1e6  # bounds of the prior's weight, in documents

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _windows(hashes: Column, width: int) -> Column:
    """Hash of every window of ``width`` words."""
    rest = lambda i: [F.get(hashes, i + k) for k in range(1, width)]
    return F.when(F.size(hashes) >= width, F.transform(F.slice(hashes, 1, F.size(hashes) - (width - 1)), lambda h, i: F.xxhash64(h, *rest(i)))).otherwise(F.array().cast("array<bigint>"))


def counts(docs: DataFrame, width: int = WINDOW_WORDS) -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words): row holds the columns of ``docs``.

    A word is hashed to 64 bits and so is a window; windows are compared by these. Only texts with a repeated window pay
    for the sort that finds how many words the repeated windows cover.
    """
    text = F.coalesce(F.col("row.text"), F.lit(""))
    has_word = lambda line: line.rlike("[^\\x20\\x09-\\x0D]")
    df = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    df = df.select("row", words(text).alias("w"), F.filter(F.split(text, "\n"), has_word).alias("lines"), F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"))
    df = df.select("row", "n_symbols", F.transform("w", lambda x: F.xxhash64(x)).alias("h"), F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"))
    df = df.select("row", "n_symbols", "word_chars", "n_dup_lines", F.size("h").cast("bigint").alias("n_words"), _windows(F.col("h"), width).alias("s"))
    pairs = F.sort_array(F.transform("s", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select("row", "n_symbols", "word_chars", "n_dup_lines", "n_words", F.when(F.size(F.array_distinct("s")) < F.size("s"), pairs).alias("o"))
    twin = lambda x, j: F.coalesce((F.get("o", j - 1)["h"] == x["h"]) | (F.get("o", j + 1)["h"] == x["h"]), F.get("o", j - 1)["h"] == x["h"], F.get("o", j + 1)["h"] == x["h"], F.lit(False))
    df = df.select("row", "n_symbols", "word_chars", "n_dup_lines", "n_words", F.sort_array(F.transform(F.filter("o", twin), lambda x: x["i"])).alias("at"))
    spans = F.transform("at", lambda i, j: F.least(F.lit(width), F.coalesce(F.get("at", j + 1) - i, F.lit(width))))
    covered = F.coalesce(F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, n: a + n), F.lit(0).cast("bigint"))
    df = df.select("row", *COUNTS[:4], covered.alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def host_rates(failures: DataFrame) -> DataFrame:
    """(source, n, failed) -> the same with rate, shrunken by a beta prior that is fitted to all hosts.

    The prior's mean is the failure rate of all documents; its weight follows from how much the hosts' rates differ
    beyond chance (method of moments with weights n). One row for each host goes in and out; sums over hosts are one row.
    """
    total = failures.agg(F.sum("n").alias("N"), F.sum("failed").alias("K"), F.count("n").alias("H"), F.sum(F.col("n").cast("double") * F.col("n")).alias("N2"), F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("n")).alias("KK"))
    m = F.col("K") / F.col("N")
    chance = m * (1 - m)
    spread = F.col("KK") - m * F.col("K") - chance * (F.col("H") - 1)
    room = chance * (F.col("N") - F.col("N2") / F.col("N") - (F.col("H") - 1))
    rho = F.when(room > 0, spread / room).otherwise(0.0)
    weight = F.when(rho <= 0, F.lit(STRONGEST)).otherwise(F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), (1 - rho) / rho)))
    prior = total.select(F.struct(m.alias("mean"), weight.alias("weight")))
    p = F.col("prior")
    return failures.select("*", prior.scalar().alias("prior")).select("source", "n", "failed", ((F.col("failed") + p["mean"] * p["weight"]) / (F.col("n") + p["weight"])).alias("rate"))


def hosts(counted: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(source, host_rate, host_kept) of every host in counted documents (source, base_failed); written once."""
    per = counted.where("source IS NOT NULL").groupBy("source").agg(F.count("source").alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("failed"))
    return cut_lineage(host_rates(cut_lineage(per)).select("source", F.col("rate").alias("host_rate"), (F.col("rate") <= max_rate).alias("host_kept")))


def judged(docs: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(row, counts, base_failed, host_rate, kept): row holds the columns of ``docs`` (doc_id, text, source, any others).

    A document is kept if the base rules and its host's verdict pass. Null texts have no words and fail. Documents
    without a host (null) are judged by the base rules alone. Each row is judged for itself, repeated or not; ties need no
    rule. Texts are read twice, once for the hosts' failures and once for the verdicts, and never shuffled for it unless
    the hosts' table is too large to be sent to the tasks, which Spark decides by its size.
    """
    if verdicts is None:
        verdicts = hosts(counts(docs.select("text", "source")).select("row.source", "base_failed"))
    known = counts(docs).join(verdicts, F.col("row.source") == verdicts.source, "left")
    return known.select("row", *COUNTS, "base_failed", "host_rate", (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"))


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    The row number holds the filter above the counts: pushed below them, it would carry them all over again.
    """
    return judged(docs).select("row", "kept", F.monotonically_increasing_id().alias("n")).where("kept AND n >= 0").select("row.*")


def op2_host_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text", "source")
    counted = cut_lineage(counts(docs).select("row.doc_id", "row.source", *COUNTS, "base_failed"))
    verdicts = hosts(counted)
    known = counted.join(verdicts, "source", "left")
    return known.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"))


OP2_SQL = f"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{GAPS}'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT rid, i, array_to_string(w[i:i + {WINDOW_WORDS - 1}], ' ') AS s FROM base, unnest(range(1, len(w) - {WINDOW_WORDS - 2})) AS t(i) WHERE len(w) >= {WINDOW_WORDS}
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT rid, sum(least({WINDOW_WORDS}, coalesce(nxt - i, {WINDOW_WORDS})))::BIGINT AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid
), counted AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN covered USING (rid)
), failing AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM counted
), per_host AS (
  SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed)::DOUBLE AS k FROM failing WHERE source IS NOT NULL GROUP BY source
), pooled AS (
  SELECT sum(n) AS nn, sum(k) / sum(n) AS m, count(*) AS h, sum(n * n) AS n2, sum(k * k / n) - sum(k) / sum(n) * sum(k) AS between_hosts FROM per_host
), moments AS (
  SELECT m, CASE WHEN m * (1 - m) * (nn - n2 / nn - (h - 1)) > 0 THEN (between_hosts - m * (1 - m) * (h - 1)) / (m * (1 - m) * (nn - n2 / nn - (h - 1))) ELSE 0 END AS rho FROM pooled
), prior AS (
  SELECT m, CASE WHEN rho <= 0 THEN {STRONGEST} ELSE greatest({WEAKEST}, least({STRONGEST}, (1 - rho) / rho)) END AS weight FROM moments
), verdict AS (
  SELECT source, (k + m * weight) / (n + weight) <= {MAX_HOST_RATE} AS host_kept FROM per_host, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(host_kept, true) AS kept
FROM failing LEFT JOIN verdict USING (source)
"""

QUERIES = {"op2_host_quality": (op2_host_quality, OP2_SQL)}
