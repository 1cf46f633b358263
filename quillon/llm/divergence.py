"""Audit of how far the sources of a language lie apart, in term frequencies.

Terms are counted for each language and source by DuckDB inside the tasks that read the
documents, batch by batch. Spark sums these counts and deals them to shards by a hash of
language and term, so that all groups of a term meet in one shard. Each shard is loaded
into a DuckDB of its task, which finds the terms kept, sums counts by group, then (with
the sums of all shards) frequencies, partial sums over its terms for each pair of
sources, and the highest terms of each source. Spark adds up the pairs and ranks.

All arithmetic is on whole numbers; DuckDB takes 128-bit ones where counts are multiplied.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, delete, filesystem, map_arrow, scratch, table

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A language keeps the terms that stand in so many of its documents.
MIN_DOCUMENTS = 10
UNIT = 1_000_000_000
TOP = 10
#: Rows of (language, source, term) for which a shard is made; a shard is what one task holds in DuckDB.
SHARD_ROWS = 500_000
#: Bytes of documents that a task counts in one go, and rows of counts that it sums again before it sends them.
BATCH_BYTES = 8 << 20
HELD_ROWS = 400_000


def _connection() -> duckdb.DuckDBPyConnection:
    """In memory, on the task's one core, never with files of its own."""
    return duckdb.connect(config={"threads": "1", "temp_directory": "", "preserve_insertion_order": "false"})


def _arrow(result) -> pa.Table:
    got = result.to_arrow_table() if hasattr(result, "to_arrow_table") else result.arrow()
    return got if isinstance(got, pa.Table) else got.read_all()


def _batches(t: pa.Table, schema: pa.Schema):
    yield from t.select(schema.names).cast(schema).combine_chunks().to_batches(max_chunksize=50_000)


COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
COUNTS_DDL = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs long): occurrences and documents of each term in each group.

    The three columns are text, lang and source; null counts as ''. Every group has a row
    whose term is '' (no term is), with its number of documents, so that groups without
    terms are there too.
    """
    text, lang, source = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source"))

    def run(batches):
        db = _connection()
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            db.register("counted", pa.concat_tables(held))
            out = _arrow(db.sql("SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM counted GROUP BY ALL"))
            db.unregister("counted")
            return out

        for batch in batches:
            step = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
            for i in range(0, batch.num_rows, step):
                db.register("docs", pa.Table.from_batches([batch.slice(i, step)]))
                held.append(
                    _arrow(
                        db.sql(
                            f"""WITH d AS (SELECT row_number() OVER () AS rid, lang, source, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM docs),
                            t AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
                            e AS (SELECT rid, lang, source, term, count(*) AS n FROM t GROUP BY ALL)
                            SELECT lang, source, term, sum(n)::BIGINT AS n, count(*) AS docs FROM e GROUP BY ALL
                            UNION ALL SELECT lang, source, '', 0, count(*) FROM d GROUP BY ALL"""
                        )
                    )
                )
                db.unregister("docs")
                if sum(len(h) for h in held) > HELD_ROWS:
                    held[:] = [summed()]
                    if len(held[0]) > HELD_ROWS // 2:  # mostly different terms: Spark sums them
                        yield from _batches(held.pop(), COUNTS)
        if held:
            yield from _batches(summed(), COUNTS)
        db.close()

    parts = map_arrow(docs.select(text, lang, source), run, COUNTS_DDL)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


PAIR = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
PAIR_DDL = "lang string, source string, part string, item string, value long"

#: What a shard knows of its terms: (lang, term) with all documents and occurrences in the language, if kept.
KEPT = "CREATE TABLE kept AS SELECT lang, term, sum(n)::BIGINT AS n FROM shard GROUP BY lang, term HAVING sum(docs) >= {least}"
#: Occurrences of kept terms by group, and (source null) by language with the number of its kept terms.
SUMS = "SELECT lang, source, sum(shard.n)::BIGINT AS n, NULL::BIGINT AS v FROM shard JOIN kept USING (lang, term) GROUP BY lang, source UNION ALL SELECT lang, NULL, sum(n)::BIGINT, count(*) FROM kept GROUP BY lang"
#: A frequency in parts of UNIT.
SHARE = "(1 + {unit}::HUGEINT * ({n} + 2) // ({total} + 2 * v))::BIGINT"
APART = "(({p} - {q})::HUGEINT * ({p} - {q}) // ({p} + {q}))::BIGINT"


def _shard(batches) -> duckdb.DuckDBPyConnection:
    """A DuckDB that holds the shard's rows as ``shard``."""
    db = _connection()
    db.execute("CREATE TABLE shard (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
    for batch in batches:
        db.register("counted", pa.Table.from_batches([batch]))
        db.execute("INSERT INTO shard SELECT lang, source, term, n, docs FROM counted")
        db.unregister("counted")
    return db


def shard_sums(shards: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, source, n, v): of every shard the occurrences of its kept terms by group; source null: of the language, and its kept terms v."""
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("v", pa.int64())])

    def run(batches):
        db = _shard(batches)
        db.execute(KEPT.format(least=least))
        yield from _batches(_arrow(db.sql(SUMS)), kind)
        db.close()

    return map_arrow(shards, run, "lang string, source string, n long, v long")


def shard_pairs(shards: DataFrame, groups: str, least: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value): of every shard the sum over its terms for each pair of sources (the lesser first), and each source's highest terms.

    ``groups`` is a Parquet folder of (lang, source, n, lang_n, v), one row a group; a task
    reads what belongs to the languages in its shard.

    A pair's sum is taken over the terms that either source has, against what terms that
    neither has would give (``zero``, the same for all of them); the rest is added by the caller.
    """

    def run(batches):
        db = _shard(batches)
        db.execute(KEPT.format(least=least))
        langs = [r[0] for r in db.sql("SELECT DISTINCT lang FROM kept").fetchall()]
        if not langs:
            db.close()
            return
        store, path = filesystem(groups)
        db.register("sources", pq.read_table(path, filesystem=store, partitioning=None, filters=[("lang", "in", langs)]))
        db.execute(
            f"""CREATE TABLE grp AS SELECT lang, source, n AS total, lang_n, v, {SHARE.format(unit=UNIT, n=0, total="n")} AS p0 FROM sources;
            CREATE TABLE freq AS SELECT k.lang, k.term, s.source, g.p0, {SHARE.format(unit=UNIT, n="s.n", total="g.total")} AS p, {SHARE.format(unit=UNIT, n="k.n", total="g.lang_n")} AS q
            FROM kept k JOIN shard s USING (lang, term) JOIN grp g ON g.lang = s.lang AND g.source = s.source WHERE s.n > 0"""
        )
        # both sources have the term: the term's value, less what the two one-sided sums below count for it
        f = lambda p, q: APART.format(p=p, q=q)
        db.execute(
            f"""CREATE TABLE pairs AS
            SELECT a.lang, a.source, b.source AS item, sum({f("a.p", "b.p")} - {f("a.p", "b.p0")} - {f("a.p0", "b.p")} + {f("a.p0", "b.p0")}) AS value
            FROM freq a JOIN freq b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL;
            CREATE TABLE sides AS SELECT lang, source, p0, p, count(*) AS terms FROM freq GROUP BY ALL"""
        )
        db.execute(
            f"""INSERT INTO pairs SELECT s.lang, least(s.source, g.source), greatest(s.source, g.source), sum(s.terms * ({f("s.p", "g.p0")} - {f("s.p0", "g.p0")}))
            FROM sides s JOIN grp g ON s.lang = g.lang AND s.source <> g.source GROUP BY ALL"""
        )
        yield from _batches(_arrow(db.sql("SELECT lang, source, 'pair' AS part, item, sum(value)::BIGINT AS value FROM pairs GROUP BY ALL")), PAIR)
        yield from _batches(
            _arrow(
                db.sql(
                    f"""SELECT lang, source, 'term' AS part, term AS item, value FROM (SELECT *, {f("p", "q")} AS value FROM freq WHERE p > q)
                    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {top}"""
                )
            ),
            PAIR,
        )
        db.close()

    return map_arrow(shards, run, PAIR_DDL)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = MIN_DOCUMENTS, top: int = TOP, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """lang, source, part, item, value long, rank int: how each source differs from the others of its language, and its terms.

    Part `pair`: every other source of the language, the farthest first. Part `term`: the
    ``top`` terms that the source has more of than the language. A null text, language or
    source is ''; documents repeated in full count each; a source alone in its language has no
    pairs, a language without kept terms pairs of 0 and no terms; an empty table gives an empty
    result; other columns are not read. No row is left out, however many one group has.
    """
    spark = docs.sparkSession
    counts = cut(term_counts(docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"))))
    terms = counts.filter("term <> ''")
    n_shards = max(spark.sparkContext.defaultParallelism, -(-counts.count() // shard_rows))
    shards = terms.repartition(n_shards, "lang", "term")
    sums = cut(shard_sums(shards, least).groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("v").alias("v")))
    langs = sums.filter("source IS NULL").select("lang", F.col("n").alias("lang_n"), "v")
    own = sums.filter("source IS NOT NULL").select("lang", "source", "n")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "lang_n", "v")]
    all_groups = counts.filter("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *zero)
    folder = scratch(spark, "divergence-groups")
    all_groups.write.parquet(folder)
    groups = spark.read.schema(all_groups.schema).parquet(folder)
    found = cut(shard_pairs(shards, folder, least, top))
    # every pair of sources is in the result, so the pairs of a language are joined in full
    p0 = (F.lit(1) + F.expr(f"CAST({2 * UNIT} AS BIGINT) div (n + 2 * v)")).alias("p0")
    some = cut(groups.select("lang", "source", "v", F.when(F.col("v") > 0, p0).otherwise(F.lit(0)).alias("p0")))
    delete(spark, folder)
    a, b = some.alias("a"), some.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")).alias("b")
    none = F.when(F.col("v") > 0, F.col("v") * F.expr("(p0 - q0) * (p0 - q0) div (p0 + q0)")).otherwise(0).alias("value")
    base = a.join(b, "lang").filter("source < item").select("lang", "source", "item", none)
    each = base.unionByName(found.filter("part = 'pair'").select("lang", "source", "item", "value")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = each.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("e"), "value")
    pairs = both.select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(found.filter("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item string, value long, rank int: pairs of sources and distinguishing terms of all documents."""
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), w AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT g.lang, g.source, k.term, k.n AS all_n, count(w.id) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term GROUP BY ALL
), s AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(all_n) OVER (PARTITION BY lang, source) AS all_total, count(*) OVER (PARTITION BY lang, source) AS v FROM c
), p AS (
  SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 2) // (total + 2 * v))::HUGEINT AS p, (1 + 1000000000::HUGEINT * (all_n + 2) // (all_total + 2 * v))::HUGEINT AS q FROM s
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), items AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM items
)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
