"""Quality rules with verdicts by host.

Every document is measured within its row by SQL functions; the measures (no
text) are cut off once. Failures of each rule are summed by host, and the hosts'
rates are shrunk towards a beta prior that is fitted to all hosts. A host fails a
rule if its rate lies above the prior's mean with some certainty (TAIL standard
deviations of its posterior), or above HOST_RATE. A document that fails a base rule is dropped
everywhere; one that fails another rule is dropped where its host fails that rule,
and is forgiven elsewhere. Main path: DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, kept_columns, table

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host fails a rule if its shrunken rate of failing documents is over this,
HOST_RATE = 0.5
#: or over the mean of all hosts by so many standard deviations of the host's own posterior (1: some 84 % certainty).
TAIL = 1.0

#: Rules over the measures. Base rules drop a document by themselves.
RULES: dict[str, str] = {
    "too_short": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "same_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}
BASE = ("too_short", "repeats")


MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def measure(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep``, then n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    Null and empty texts have no words and no lines. Windows that may repeat are found
    by their hashes; in texts where two hashes are equal, the words of these windows
    are compared. Rows that repeat are measured each; an empty table gives an empty
    result; of ``keep``, columns named like a measure are left out.
    """
    keep = kept_columns(keep or ["doc_id"], MEASURES)
    own = [F.col(f"`{c}`") for c in keep]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words, lines, hashes, order = (F.col(f"_quillon_{c}") for c in ("words", "lines", "hashes", "order"))
    split = docs.select(
        *own,
        F.array_remove(F.split(text, SPACE + "+"), "").alias("_quillon_words"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("_quillon_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_quillon_lines"),
    )
    window = lambda i: [F.get(words, i + k) for k in range(WINDOW)]
    hashed = split.select(
        *own,
        words,
        F.size(words).cast("long").alias("_quillon_n"),
        F.length(F.array_join(words, "")).cast("long").alias("_quillon_chars"),
        "_quillon_symbols",
        F.size(lines).cast("long").alias("_quillon_n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("_quillon_dup_lines"),
        F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*window(i)))).alias("_quillon_hashes"),
    )
    counts = [F.col(f"_quillon_{c}") for c in ("n", "chars", "symbols", "n_lines", "dup_lines")]

    def alike(e: Column, k: Column) -> Column:
        """Whether the entry before or after in sorted order has the same x."""
        return F.coalesce(F.when(k > 0, F.get(order, k - 1)["x"] == e["x"]), F.lit(False)) | F.coalesce(F.get(order, k + 1)["x"] == e["x"], F.lit(False))

    entry = lambda x, i: F.struct(x.alias("x"), i.alias("i"))
    again = F.size(F.array_distinct(hashes)) < F.size(hashes)
    by_hash = hashed.select(*own, *counts, words, F.when(again, F.array_sort(F.transform(hashes, entry))).alias("_quillon_order"))
    # words hold no white space, so those of a window are alike only if they are when joined
    by_words = by_hash.select(*own, *counts, F.array_sort(F.transform(F.filter(order, alike), lambda e: entry(F.array_join(F.array(*window(e["i"])), " "), e["i"]))).alias("_quillon_order"))
    starts = F.array_sort(F.transform(F.filter(order, alike), lambda e: e["i"]))
    # each start covers WINDOW words, fewer where the start before it lies nearer
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    repeated = F.coalesce(F.when(order.isNotNull(), covered), F.lit(0)).cast("long")
    return by_words.select(*own, *(c.alias(m) for c, m in zip([*counts, repeated], MEASURES)))


def host_verdicts(measured: DataFrame, host_col: str = "source", threshold: float = HOST_RATE, tail: float = TAIL) -> DataFrame:
    """One row per host: the host, documents, and for each rule its shrunken rate and whether the host fails it.

    The prior's mean and strength come from the hosts' own rates by the method of
    moments; where they don't vary, its strength is that of one document. A null host
    has no verdict; an empty table gives an empty result.
    """
    fails = {r: F.expr(e).cast("long") for r, e in RULES.items()}
    hosts = cut(measured.filter(F.col(host_col).isNotNull()).groupBy(host_col).agg(F.count(F.lit(1)).alias("documents"), *(F.sum(e).alias(f"failed_{r}") for r, e in fails.items())))
    moments = hosts.agg(*(f(F.col(f"failed_{r}") / F.col("documents")).alias(f"{n}_{r}") for r in RULES for n, f in (("mean", F.avg), ("var", F.var_pop)))).first()
    out = hosts
    for r in RULES:
        mean, var = moments[f"mean_{r}"] or 0.0, moments[f"var_{r}"] or 0.0
        strength = max(mean * (1 - mean) / var - 1, 1.0) if var > 1e-12 else 1.0
        weight = F.col("documents") + F.lit(strength)
        rate = (F.col(f"failed_{r}") + F.lit(mean * strength)) / weight
        deviation = F.sqrt(rate * (1 - rate) / (weight + 1))  # of the host's beta posterior
        out = out.withColumn(f"rate_{r}", rate).withColumn(f"host_fails_{r}", (rate > threshold) | (rate - F.lit(tail) * deviation > F.lit(mean)))
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Identifier, host, the columns ``keep``, the measures and the verdict of each row: base_failed, host_failed, kept.

    kept is false if a base rule fails or if the document fails a rule that its
    host fails. Documents without a host are judged by the base rules alone. Hot
    hosts are summed before the shuffle, and the join of their verdicts is one that
    adaptive execution can split. Null texts have no words and fail; rows that
    repeat are judged each; an empty table gives an empty result; of ``keep``, columns
    named like a result are left out.
    """
    verdict = ["base_failed", "host_failed", "kept"]
    keep = kept_columns([id_col, host_col, *(keep or [])], [*MEASURES, *verdict])
    measured = cut(measure(docs.withColumn("_quillon_host", F.col(f"`{host_col}`")), text_col, [*keep, "_quillon_host"]))
    verdicts = cut(host_verdicts(measured, "_quillon_host").select("_quillon_host", *(F.col(f"host_fails_{r}").alias(f"_quillon_fails_{r}") for r in RULES)))
    joined = measured.join(verdicts, "_quillon_host", "left")
    host_failed = F.lit(False)
    for r, e in RULES.items():
        host_failed = host_failed | (F.coalesce(f"_quillon_fails_{r}", F.lit(False)) & F.expr(e))
    base_failed = F.lit(False)
    for r in BASE:
        base_failed = base_failed | F.expr(RULES[r])
    return joined.select(*(F.col(f"`{c}`") for c in keep), *MEASURES, base_failed.alias("base_failed"), host_failed.alias("host_failed"), (~base_failed & ~host_failed).alias("kept"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words long, base_failed, kept, host_failed boolean.

    Null texts have no words and fail; repeated rows are judged each; an empty table
    gives an empty result; columns other than doc_id, text and source are not read.
    """
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed")


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), win AS (
  SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)
), tests AS (
  SELECT rid, source, 'short' AS rule, n_words < 10 AS bad, TRUE AS base FROM m
  UNION ALL SELECT rid, source, 'again', n_repeat_words * 5 > n_words, TRUE FROM m
  UNION ALL SELECT rid, source, 'signs', n_symbols * 10 > n_words, FALSE FROM m
  UNION ALL SELECT rid, source, 'lines', n_dup_lines * 10 > n_lines * 3, FALSE FROM m
  UNION ALL SELECT rid, source, 'sizes', NOT (word_chars BETWEEN n_words * 2 AND n_words * 15), FALSE FROM m
), hosts AS (
  SELECT source, rule, count(*) AS docs, count(*) FILTER (WHERE bad) AS failed FROM tests WHERE source IS NOT NULL GROUP BY source, rule
), prior AS (
  SELECT rule, avg(failed::DOUBLE / docs) AS mean, var_pop(failed::DOUBLE / docs) AS var FROM hosts GROUP BY rule
), beta AS (
  SELECT rule, mean, CASE WHEN var > 1e-12 AND mean * (1 - mean) / var > 2 THEN mean * (1 - mean) / var - 1 ELSE 1 END AS size FROM prior
), post AS (
  SELECT source, rule, mean, docs + size AS size, (failed + mean * size) / (docs + size) AS rate FROM hosts JOIN beta USING (rule)
), sentence AS (
  SELECT source, rule, rate > 0.5 OR rate - sqrt(rate * (1 - rate) / (size + 1)) > mean AS guilty FROM post
), verdict AS (
  SELECT rid, bool_or(bad AND base) AS base_failed, bool_or(bad AND coalesce(guilty, FALSE)) AS host_failed
  FROM tests LEFT JOIN sentence USING (source, rule) GROUP BY rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR host_failed) AS kept, host_failed
FROM m JOIN verdict USING (rid)
"""
