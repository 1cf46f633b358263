"""Segmentation, interval joins, sampling and streaming over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import relations, sample, segment, windows
from quillon.plans.agreement_queries import EV, r6
from quillon.plans.registry import CRC, CRC_TABLE, query
from quillon.sources.shared import scratch
from quillon.sources.tables import events, table
from quillon.streaming import jobs

#: A labeller's events as a recording: a word every event, lasting value / 20 seconds of a time axis of hours.
WORDS = EV + ", wd AS (SELECT who AS source, epoch_us(tm) / 1e6 / 3600 - 473352 AS s, epoch_us(tm) / 1e6 / 3600 - 473352 + value / 20 AS e, label AS word FROM ev)"


def words(spark, d):
    t = F.unix_micros(F.col("at").cast("timestamp")) / 1e6 / 3600 - 473352
    return events(spark, d).select(F.col("who").alias("source"), t.alias("start"), (t + F.col("value") / 20).alias("end"), F.col("label").alias("word"))


LAST = "l AS (SELECT source, s, e, word, lag(e, 1, 0.0) OVER (PARTITION BY source ORDER BY s, e) AS p FROM wd)"


@query("words_to_alignment", f"WITH {WORDS}, {LAST} SELECT source, 'word' AS type, round(s, 4) AS \"start\", round(e, 4) AS \"end\", word FROM l UNION ALL SELECT source, 'silence', round(p, 4), round(s, 4), NULL FROM l WHERE s - p > 0.7")
def words_to_alignment(spark, d):
    return segment.words_to_alignment(words(spark, d)).select("source", "type", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "word")


GAPS = f"{WORDS}, g AS (SELECT source, s, max(e) OVER (PARTITION BY source ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM wd), gp AS (SELECT source, r AS g0, s AS g1 FROM g WHERE s - r >= 0.8)"


@query("word_gaps", f"WITH {GAPS} SELECT source, round(g0, 4) AS \"start\", round(g1, 4) AS \"end\" FROM gp")
def word_gaps(spark, d):
    return segment.gaps_between_words(words(spark, d)).select("source", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


@query("gap_windows", f"WITH {GAPS}, w AS (SELECT source, g0, g1, unnest(range(0, CAST(floor((g1 - g0 - 1.5) / 12) AS BIGINT) + 1)) AS k FROM gp WHERE g1 - g0 >= 1.5) SELECT source, round(g0 + 12 * k, 4) AS \"start\", round(least(g0 + 12 * (k + 1), g1), 4) AS \"end\" FROM w")
def gap_windows(spark, d):
    g = segment.gaps_between_words(words(spark, d)).select("source", F.explode(segment.gap_windows(F.col("start"), F.col("end"))).alias("w"))
    return g.select("source", F.round("w.start", 4).alias("start"), F.round("w.end", 4).alias("end"))


@query("dense_windows", f"WITH {GAPS}, w AS (SELECT source, g0, g1, unnest(range(0, greatest(CAST(ceil((g1 - 0.4 - g0) / 3) AS BIGINT) - 1, 0) + 1)) AS k FROM gp) SELECT source, round(greatest(0, g0 + 3 * k - 1), 4) AS window_start, round(least(8, g1 - g0 - 3 * k + 2), 4) AS window_seconds FROM w")
def dense_windows(spark, d):
    w = segment.dense_windows(segment.gaps_between_words(words(spark, d)))
    return w.select("source", F.round("window_start", 4).alias("window_start"), F.round("window_seconds", 4).alias("window_seconds"))


@query("video_windows", "WITH s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'single' ELSE 'chapter' END AS kind, 0.0::DOUBLE AS a, p_retailprice * 3 AS b FROM part), t AS (SELECT id, a + x AS a, b - x AS b FROM (SELECT *, CASE WHEN kind = 'single' AND b - a > 180 THEN 60.0 WHEN kind = 'chapter' AND b - a > 12 THEN 3.0 ELSE 0.0 END AS x FROM s)), n AS (SELECT *, CAST(greatest(1, floor((b - a) / 30)) AS INT) AS n FROM t), i AS (SELECT *, unnest(range(0, least(n, 80))) AS i FROM n) SELECT id, round(a + 30 * CASE WHEN n <= 80 THEN i ELSE CAST(round_even(i * (n - 1) / 79, 0) AS INT) END, 4) AS window_start FROM i")
def video_windows(spark, d):
    s = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "single").otherwise("chapter").alias("kind"), F.lit(0.0).alias("start"), (F.col("p_retailprice") * 3).alias("end"))
    return segment.video_windows(s).select("id", F.round("window_start", 4).alias("window_start"))


#: A recording's entries in order: words, and silences before those after a longer gap; then a fold over them, one by one.
SPLIT = f"""WITH RECURSIVE {WORDS}, pv AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY source ORDER BY s, e), 0) AS pe FROM wd),
 en AS (SELECT source, s, e, TRUE AS said, word FROM pv UNION ALL SELECT source, pe, s, FALSE, NULL FROM pv WHERE s - pe > 0.7), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s, e) AS i FROM en WHERE e > s),
 f(source, i, a, b, t, shut) AS (SELECT DISTINCT source, 0::BIGINT, NULL::DOUBLE, NULL::DOUBLE, []::VARCHAR[], NULL::STRUCT(a DOUBLE, b DOUBLE, t VARCHAR[]) FROM o UNION ALL
  SELECT f.source, o.i, CASE WHEN NOT said AND o.e - o.s > 0.7 THEN NULL WHEN NOT said THEN f.a WHEN f.a IS NULL OR o.s - f.b > 0.7 OR o.e - f.a > 20 THEN o.s ELSE f.a END,
   CASE WHEN said THEN o.e WHEN o.e - o.s > 0.7 THEN NULL ELSE f.b END,
   CASE WHEN NOT said AND o.e - o.s > 0.7 THEN [] WHEN NOT said THEN f.t WHEN f.a IS NULL OR o.s - f.b > 0.7 OR o.e - f.a > 20 THEN [o.word] ELSE list_append(f.t, o.word) END,
   CASE WHEN f.a IS NOT NULL AND ((said AND (o.s - f.b > 0.7 OR o.e - f.a > 20)) OR (NOT said AND o.e - o.s > 0.7)) THEN {{'a': f.a, 'b': f.b, 't': f.t}} END
  FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1),
 p AS (SELECT source, unnest(shut) FROM f WHERE shut IS NOT NULL UNION ALL SELECT source, a, b, t FROM (SELECT source, a, b, t, row_number() OVER (PARTITION BY source ORDER BY i DESC) AS z FROM f) WHERE z = 1 AND a IS NOT NULL),
 q AS (SELECT *, min(i) FILTER (said) OVER (PARTITION BY source) AS fw FROM o),
 x AS (SELECT source, a AS s, b AS e, 'speech' AS kind, array_to_string(t, ' ') AS text FROM p WHERE b - a BETWEEN 1 AND 20
  UNION ALL SELECT source, s + n * 12, least(s + n * 12 + 12, e), 'trigger_candidate', NULL FROM (SELECT *, unnest(range(0, floor((e - s - 1.5) / 12)::BIGINT + 1)) AS n FROM q WHERE NOT said AND i > fw AND e - s >= 1.5))
 SELECT source::VARCHAR AS source, s AS start, e AS \"end\", kind, text, source || '_' || lpad(floor(s * 1000)::BIGINT::VARCHAR, 9, '0') AS uid FROM x"""


@query("split_alignment", SPLIT)
def split_alignment(spark, d):
    """Phrases and gap windows of each labeller's stream."""
    rows = segment.words_to_alignment(words(spark, d))
    rec = rows.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("start", "end", "type", "word"))).alias("e"))
    rec = rec.select(F.col("source").cast("string").alias("source"), F.transform("e", lambda x: F.struct(x["type"].alias("type"), x["start"].alias("start"), x["end"].alias("end"), x["word"].alias("word"))).alias("entries"))
    return segment.split_alignment(rec)


@query("span_summary", f"WITH {GAPS}, x AS (SELECT 'speech' AS kind, e - s AS d, 1 AS w FROM wd UNION ALL SELECT 'gap', g1 - g0, 0 FROM gp) SELECT kind, count(*) AS spans, round(sum(d), 3) AS seconds, CAST(sum(w) AS BIGINT) AS words FROM x GROUP BY kind")
def span_summary(spark, d):
    w = words(spark, d)
    s = w.select("start", "end", F.lit("speech").alias("kind"), F.col("word").alias("text")).unionByName(segment.gaps_between_words(w).select("start", "end", F.lit("gap").alias("kind"), F.lit(None).cast("string").alias("text")))
    return segment.span_summary(s).select("kind", "spans", F.round("seconds", 3).alias("seconds"), "words")


@query("longest_quiet", f"WITH {EV}, f AS (SELECT who, row_number() OVER (PARTITION BY who ORDER BY tm, event_id) AS i, value FROM ev), q AS (SELECT who, i, i - row_number() OVER (PARTITION BY who ORDER BY i) AS g FROM f WHERE value < 50), r AS (SELECT who, min(i) AS s, count(*) AS n FROM q GROUP BY who, g), k AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY n DESC, s) AS k FROM r) SELECT who, s AS \"start\", n AS length FROM k WHERE k = 1")
def longest_quiet(spark, d):
    from pyspark.sql import Window as W

    f = events(spark, d).withColumn("i", F.row_number().over(W.partitionBy("who").orderBy("at", "event_id")))
    return segment.longest_quiet(f, F.col("value") < 50, "who")


@query("announcements", f"WITH {WORDS}, {LAST}, x AS (SELECT source, 'word' AS type, s, e, word FROM l UNION ALL SELECT source, 'silence', p, s, NULL FROM l WHERE s - p > 0.7), n AS (SELECT *, lead(type) OVER w AS t, lead(s) OVER w AS s1, lead(e) OVER w AS e1 FROM x WINDOW w AS (PARTITION BY source ORDER BY s, e)) SELECT source, CASE word WHEN 'click' THEN 'tapping' ELSE 'brushing' END AS label, round(s1, 4) AS \"start\", round(least(8.0, e1 - s1), 4) AS seconds FROM n WHERE word IN ('click', 'view') AND t = 'silence' AND least(8.0, e1 - s1) >= 0.6")
def announcements(spark, d):
    """Label words right before a silence."""
    a = segment.announcements(segment.words_to_alignment(words(spark, d)), {"click": "tapping", "view": "brushing"})
    return a.select("source", "label", F.round("start", 4).alias("start"), F.round("seconds", 4).alias("seconds"))


#: The documents hold no brackets, so the script's pieces are known.
@query("script_tags", "WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, 'trigger' AS kind, NULL AS text, 'brushing' AS name, 0.5::DOUBLE AS intensity, 'soft' AS modifier FROM t UNION ALL SELECT doc_id, 'speech', t, NULL, NULL, NULL FROM t WHERE t <> '' UNION ALL SELECT doc_id, 'speech', 'ok', NULL, NULL, NULL FROM t UNION ALL SELECT doc_id, 'trigger', NULL, 'tapping', 0.65, NULL FROM t")
def script_tags(spark, d):
    """Speech and triggers of scripts made from documents; golden cases are in the tests."""
    t = F.concat(F.lit("[soft][brushing] "), "text", F.lit(" [vigorous] ok [tapping]"))
    s = table(spark, d, "documents").select("doc_id", F.explode(segment.parse_script(t)).alias("s"))
    return s.select("doc_id", "s.*")


@query("word_error_rate")
def word_error_rate(spark, d):
    """First turns against second turns of conversations."""
    c = table(spark, d, "conversations")
    a = c.filter("turn = 0").select("conv_id", F.col("text").alias("reference"))
    b = c.filter("turn = 1").select("conv_id", F.col("text").alias("heard"))
    return segment.word_error_rate(a.join(b, "conv_id")).select("conv_id", "deletions", "insertions", "substitutions", "wer")


#: Clips in order of start, put together one by one: what is closed before a clip, and what a clip closes.
CONCAT = f"""WITH RECURSIVE {WORDS}, o AS (SELECT source, word || '_' || s AS file, word AS text, e - s AS d, row_number() OVER (PARTITION BY source ORDER BY s) AS i FROM wd),
 f(source, i, g, total, out) AS (SELECT DISTINCT source, 0::BIGINT, []::STRUCT(text VARCHAR, d DOUBLE)[], 0::DOUBLE, []::STRUCT(text VARCHAR, d DOUBLE)[][] FROM o UNION ALL
  SELECT source, i, CASE WHEN full_now THEN [] ELSE g3 END, CASE WHEN full_now THEN 0 ELSE t3 END, list_concat(CASE WHEN shut AND len(g0) >= 2 THEN [g0] ELSE [] END, CASE WHEN full_now AND len(g3) >= 2 THEN [g3] ELSE [] END) FROM (
   SELECT *, t3 >= 5 AND NOT too_long AS full_now FROM (SELECT *, CASE WHEN too_long THEN [] ELSE list_append(g2, {{'text': text, 'd': d}}) END AS g3, CASE WHEN too_long THEN 0 ELSE t2 + d + CASE WHEN len(g2) > 0 THEN 0.1::DOUBLE ELSE 0 END END AS t3 FROM (
    SELECT *, CASE WHEN shut THEN [] ELSE g0 END AS g2, CASE WHEN shut THEN 0 ELSE total END AS t2 FROM (
     SELECT f.source, o.i, f.g AS g0, f.total, o.text, o.d, o.d > 8 AS too_long, o.d > 8 OR (len(f.g) > 0 AND f.total + 0.1::DOUBLE + o.d > 8) AS shut FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1))))),
 w AS (SELECT source, unnest(out) AS g FROM f UNION ALL SELECT source, g FROM (SELECT source, g, row_number() OVER (PARTITION BY source ORDER BY i DESC) AS z FROM f) WHERE z = 1 AND len(g) >= 2)
 SELECT source::VARCHAR AS source, len(g)::INT AS files, array_to_string(list_transform(g, lambda x: x.text), ' ') AS text, round(list_sum(list_transform(g, lambda x: x.d)) + 0.1 * (len(g) - 1), 5) AS seconds FROM w"""


@query("concat_neighbours", CONCAT)
def concat_neighbours(spark, d):
    s = words(spark, d).select(F.col("source").cast("string").alias("source"), F.concat("word", F.lit("_"), F.col("start").cast("string")).alias("file_name"), F.col("word").alias("text"), "start", (F.col("end") - F.col("start")).alias("duration"))
    return segment.concat_neighbours(s).select("source", F.size("files").alias("files"), "text", F.round("seconds", 5).alias("seconds"))


SPANS_SQL = "sp AS (SELECT user_id AS k, value AS s, value + 4 AS e, event_id AS id FROM events WHERE event_type = 'view')"
POINTS = "pt AS (SELECT event_id AS id, user_id AS k, value AS t FROM events WHERE event_type = 'click')"


def point_rows(spark, d):
    return table(spark, d, "events").filter("event_type = 'click'").select(F.col("event_id").alias("id"), F.col("user_id").alias("k"), F.col("value").alias("t"))


def span_rows(spark, d):
    return table(spark, d, "events").filter("event_type = 'view'").select(F.col("user_id").alias("k"), F.col("value").alias("s"), (F.col("value") + 4).alias("e"), F.col("event_id").alias("sid"))


@query("interval_lookup", f"WITH {SPANS_SQL}, {POINTS}, j AS (SELECT pt.id, sp.id AS sid, row_number() OVER (PARTITION BY pt.id ORDER BY sp.id DESC) AS r FROM pt LEFT JOIN sp ON pt.k = sp.k AND t >= s - 0.05 AND t < e) SELECT id, sid FROM j WHERE r = 1")
def interval_lookup(spark, d):
    return relations.interval_lookup(point_rows(spark, d), span_rows(spark, d), "k", "t", "s", "e", F.col("sid"), bucket=10.0).select("id", F.col("span.sid").alias("sid"))


@query("without_overlap", f"WITH {SPANS_SQL}, {POINTS} SELECT id FROM pt WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.k = pt.k AND s < t + 3 AND t < e)")
def without_overlap(spark, d):
    w = point_rows(spark, d).withColumnRenamed("t", "start")
    s = span_rows(spark, d).select("k", F.col("s").alias("start"), F.col("e").alias("end"))
    return relations.without_overlap(w, s, "k", 3.0, 10.0).select("id")


@query("contained_phrases", f"WITH {SPANS_SQL}, {POINTS} SELECT sp.id AS window_id, pt.id AS phrase_id FROM sp JOIN pt ON sp.k = pt.k AND t >= s - 0.01 AND t + 1 <= e + 0.01")
def contained_phrases(spark, d):
    w = span_rows(spark, d).select("k", F.col("s").alias("start"), F.col("e").alias("end"), F.col("sid").alias("window_id"))
    p = point_rows(spark, d).select("k", F.col("t").alias("start"), (F.col("t") + 1).alias("end"), F.col("id").alias("phrase_id"))
    return relations.contained(p, w, "k", bucket=10.0).select("window_id", F.col("p_phrase_id").alias("phrase_id"))


@query("as_of", "WITH l AS (SELECT event_id AS id, user_id AS k, ts FROM events WHERE event_type = 'click'), r AS (SELECT user_id AS k, ts, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT id, v FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.ts >= r.ts")
def as_of(spark, d):
    e = table(spark, d, "events")
    left = e.filter("event_type = 'click'").select(F.col("event_id").alias("id"), F.col("user_id").alias("k"), "ts")
    right = e.filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("k"), "ts").agg(F.max("value").alias("v"))
    return relations.as_of(left, right, "k", "ts", "v").select("id", "v")


def parts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("label"), F.col("p_type").alias("creator"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("score"))


@query("capped_top", "WITH r AS (SELECT p_partkey AS key, p_retailprice AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) SELECT key, score FROM r WHERE r <= 3 ORDER BY score DESC, key LIMIT 40")
def capped_top(spark, d):
    return sample.capped_top(parts(spark, d), "score", "key", "label", 3, 40).select("key", "score")


@query("two_caps", "WITH a AS (SELECT p_partkey AS key, p_brand AS label, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS a FROM part), b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY key) AS b FROM a WHERE a <= 2) SELECT label, key FROM b WHERE b <= 10")
def two_caps(spark, d):
    return sample.two_caps(parts(spark, d), "label", "creator", "key", 2, 10).select("label", "key")


@query("cap_groups", "WITH r AS (SELECT p_partkey AS key, p_type AS creator, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS r FROM part), k AS (SELECT * FROM r WHERE r <= 12) SELECT key, creator FROM k WHERE creator IN (SELECT creator FROM k GROUP BY creator HAVING count(*) >= 11)")
def cap_groups(spark, d):
    return sample.cap_groups(parts(spark, d), "creator", 12, ["key"], 11).select("key", "creator")


@query("strided_split", "WITH s AS (SELECT creator, row_number() OVER (ORDER BY creator) - 1 AS i FROM (SELECT DISTINCT p_type AS creator FROM part)) SELECT p_partkey AS key, CASE WHEN i % 4 = 0 THEN 'eval' ELSE 'train' END AS split FROM part JOIN s ON p_type = creator")
def strided_split(spark, d):
    return sample.strided_split(parts(spark, d), "creator", 4).select("key", "split")


@query("within_budget", "WITH r AS (SELECT p_partkey AS key, p_brand AS label, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM part) SELECT key, label, running FROM r WHERE running <= 300")
def within_budget(spark, d):
    return sample.within_budget(parts(spark, d), "size", [F.col("score").desc(), "key"], 300, "label").select("key", "label", "running")


@query("class_weights", "WITH g AS (SELECT p_brand AS label, count(*) AS rows, sum(p_size)::DOUBLE AS effective FROM part GROUP BY 1) SELECT label, rows, effective, round(sqrt(effective) / (SELECT avg(sqrt(effective)) FROM g), 6) AS class_weight FROM g")
def class_weights(spark, d):
    return sample.class_weights(parts(spark, d).withColumn("w", F.col("size").cast("double")), "label", "w").withColumn("class_weight", F.round("class_weight", 6))


@query("interleave", "WITH r AS (SELECT p_partkey AS key, p_brand AS label, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS position FROM part), g AS (SELECT label, row_number() OVER (ORDER BY min(key), label) AS group_rank FROM r GROUP BY label) SELECT key, CAST(position AS INT) AS position, CAST(group_rank AS INT) AS group_rank FROM r JOIN g USING (label)")
def interleave(spark, d):
    return sample.interleave(parts(spark, d), "label", ["key"], "key").select("key", "position", "group_rank")


@query("gold_pick", "WITH c AS (SELECT l_partkey AS clip, l_returnflag AS label, avg(l_discount) * 8 AS p FROM lineitem GROUP BY 1, 2), a AS (SELECT clip, label, p FROM c WHERE label = 'A' AND p >= 0.3 ORDER BY p DESC, clip LIMIT 12), n AS (SELECT clip, label, p FROM c WHERE label = 'N' AND p >= 0.3 AND clip NOT IN (SELECT clip FROM a) ORDER BY p DESC, clip LIMIT 12) SELECT clip, label, round(p, 6) AS p FROM a UNION ALL SELECT clip, label, round(p, 6) FROM n")
def gold_pick(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("clip"), F.col("l_returnflag").alias("label")).agg((F.avg("l_discount") * 8).alias("p"))
    return sample.gold_pick(c, ["A", "N"]).select("clip", "label", r6("p", "p"))


@query("preference_pairs", "WITH t AS (SELECT l_orderkey AS uid, l_linenumber AS take, l_quantity AS score FROM lineitem), b AS (SELECT uid, min((score, take)) AS b FROM t GROUP BY uid) SELECT uid, b[2] AS chosen, take AS rejected, score - b[1] AS margin FROM t JOIN b USING (uid) WHERE score - b[1] >= 20")
def preference_pairs(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("take"), F.col("l_quantity").alias("score"))
    return sample.preference_pairs(t, gap=20.0)


@query("bag_scores", "WITH r AS (SELECT l_orderkey AS bag, l_quantity AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT bag, any_value(n) AS n, round(avg(s), 6) AS score FROM r WHERE r <= 3 GROUP BY bag")
def bag_scores(spark, d):
    return sample.bag_scores(table(spark, d, "lineitem"), "l_orderkey", "l_quantity").select(F.col("l_orderkey").alias("bag"), "n", r6("score", "score"))


@query("round_robin_quota", "WITH s AS (SELECT p_partkey AS key, p_type AS creator, p_brand AS label, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY md5('0|' || p_partkey), p_partkey) AS s FROM part), t AS (SELECT *, row_number() OVER (PARTITION BY creator ORDER BY s, md5('0|' || label), label) AS t FROM s) SELECT key, creator, label FROM t WHERE t <= 10 ORDER BY t, md5('0|' || creator), creator LIMIT 200")
def round_robin_quota(spark, d):
    return sample.round_robin_quota(parts(spark, d), 200, 0.05, "creator", "label", "key").select("key", "creator", "label")


@query("tempered_sample", f"WITH {EV}, n AS (SELECT label, count(*) AS n FROM ev GROUP BY 1), t AS (SELECT label, least(n, floor(3000 * sqrt(n) / (SELECT sum(sqrt(n)) FROM n))) AS t FROM n), r AS (SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('0|' || event_id), event_id) AS r FROM ev) SELECT event_id, label FROM r JOIN t USING (label) WHERE r <= t")
def tempered_sample(spark, d):
    e = events(spark, d)
    return sample.tempered_sample(e, "label", "event_id", 3000).select("event_id", "label")


@query("creator_split", "WITH p AS (SELECT DISTINCT p_type AS creator FROM part), e AS (SELECT creator FROM p ORDER BY creator <> 'ECONOMY BRASS', md5('0|' || creator), creator LIMIT 5) SELECT p_partkey AS key, p_type AS creator, CASE WHEN p_type IN (SELECT creator FROM e) THEN 'eval' ELSE 'train' END AS split FROM part")
def creator_split(spark, d):
    return sample.creator_split(parts(spark, d), "creator", 5, pinned=["ECONOMY BRASS"]).select("key", "creator", "split")


@query("hash_split_folds", f"WITH {CRC_TABLE}, c AS (SELECT p_partkey AS key, {CRC.format(k='p_type')} AS crc, md5('0|' || p_type) AS h FROM part, crc_table) SELECT key, CASE WHEN crc % 1000 < 100 THEN 'eval' ELSE 'train' END AS split, CAST(('0x' || h[1:8])::BIGINT % 5 AS INT) AS fold FROM c")
def hash_split_folds(spark, d):
    return sample.folds(sample.hash_split(parts(spark, d), "creator", 0.1), "creator").select("key", "split", "fold")


# -- streams: the table is read as a file stream and run to its end


def event_stream(spark, d):
    schema = table(spark, d, "events").schema
    folder = scratch(spark, "event-files")
    table(spark, d, "events").repartition(4, "user_id").write.parquet(folder)  # files for the stream to follow
    s = jobs.follow(spark, folder, schema, "parquet", 2)
    return s.withColumn("at", F.col("ts").cast("timestamp"))


@query("stream_once_each", "SELECT DISTINCT user_id FROM events")
def stream_once_each(spark, d):
    """Each labeller once within forty days, which all events span: state is bounded by the watermark."""
    return jobs.collected(jobs.once_each(event_stream(spark, d), "user_id", "at", "40 days")).select("user_id")


@query("stream_snapshot", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS largest FROM events GROUP BY 1")
def stream_snapshot(spark, d):
    e = jobs.collected(jobs.snapshot(event_stream(spark, d), ["event_type"], "value"), "update")
    return jobs.latest(e, ["event_type"]).withColumn("total", F.round("total", 4))


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS \"start\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    w = jobs.windowed(event_stream(spark, d), "at", "1 day", ["event_type"], "value", late="40 days")
    return jobs.latest(jobs.collected(w, "update"), ["start", "end", "event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


#: A labeller's requests in order, folded one by one; what runs out at the end is told once the last request of all is a minute later.
LEASES = """WITH RECURSIVE e AS (SELECT user_id AS who, CAST(json_extract_string(props, '$.k') AS INT) AS item, ts AS t, event_type = 'purchase' AS done, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(json_extract_string(props, '$.k') AS INT)) AS k FROM events),
 f(who, k, out, held, until) AS (SELECT DISTINCT who, 0::BIGINT, []::STRUCT(item INT, event VARCHAR, t TIMESTAMP, until TIMESTAMP)[], NULL::INT, NULL::TIMESTAMP FROM e
  UNION ALL SELECT f.who, e.k, list_concat(CASE WHEN e.t >= f.until THEN [{'item': f.held, 'event': 'expired', 't': f.until, 'until': f.until}] ELSE [] END,
    CASE WHEN f.until > e.t AND e.done THEN [{'item': f.held, 'event': 'done', 't': e.t, 'until': f.until}] WHEN f.until > e.t THEN [{'item': f.held, 'event': 'kept', 't': e.t, 'until': f.until}]
     WHEN e.done THEN [] ELSE [{'item': e.item, 'event': 'granted', 't': e.t, 'until': e.t + INTERVAL 12 HOUR}] END),
   CASE WHEN f.until > e.t AND NOT e.done THEN f.held WHEN e.done THEN NULL ELSE e.item END, CASE WHEN f.until > e.t AND NOT e.done THEN f.until WHEN e.done THEN NULL ELSE e.t + INTERVAL 12 HOUR END
  FROM f JOIN e ON e.who = f.who AND e.k = f.k + 1),
 last AS (SELECT who, arg_max(held, k) AS item, arg_max(until, k) AS until FROM (SELECT who, k, coalesce(held, -1) AS held, coalesce(until, TIMESTAMP '9999-01-01') AS until FROM f) GROUP BY who),
 told AS (SELECT who, unnest(out, recursive := true) FROM f UNION ALL SELECT who, item, 'expired', until, until FROM last WHERE until <= (SELECT max(t) FROM e) - INTERVAL 1 MINUTE)
 SELECT who, item, event, t AS at, until AS expires_at FROM told"""


@query("stream_leases", LEASES)
def stream_leases(spark, d):
    """Leases of twelve hours, ended by purchases or by time; the stream stops half-way and goes on from its checkpoint."""
    e = table(spark, d, "events").select(F.col("user_id").alias("who"), F.get_json_object("props", "$.k").cast("int").alias("item"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "purchase").alias("done"))
    ends = e.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    folder, check, out = (scratch(spark, f"leases-{x}") for x in ("in", "checkpoint", "out"))
    half = F.lit(ends.a + (ends.b - ends.a) / 2) if ends.a else F.lit(None).cast("timestamp")
    told = None
    with jobs.own_state(spark):
        for part in (F.col("at") <= half, F.col("at") > half):
            e.filter(part).write.mode("append").parquet(folder)
            told = jobs.leases(jobs.follow(spark, folder, e.schema, "parquet"), minutes=12 * 60, done="done")
            jobs.run_available(told, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), check)
    rows = spark.read.schema(told.schema).parquet(out)
    return rows.select("who", "item", "event", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("at", "expires_at")))


CONTEXT = f"WITH {GAPS}, b AS (SELECT g.source, g0, g1, word, row_number() OVER (PARTITION BY g.source, g0, g1 ORDER BY e DESC, s DESC, word DESC) AS r FROM gp g JOIN wd ON wd.source = g.source AND e <= g0), a AS (SELECT g.source, g0, g1, word, row_number() OVER (PARTITION BY g.source, g0, g1 ORDER BY s, e, word) AS r FROM gp g JOIN wd ON wd.source = g.source AND s >= g1), tb AS (SELECT source, g0, g1, string_agg(word, ' ' ORDER BY r DESC) AS t FROM b WHERE r <= 8 GROUP BY ALL), ta AS (SELECT source, g0, g1, string_agg(word, ' ' ORDER BY r) AS t FROM a WHERE r <= 8 GROUP BY ALL) SELECT source, g0 AS start, g1 AS \"end\", coalesce(tb.t, '') AS before, coalesce(ta.t, '') AS after FROM gp LEFT JOIN tb USING (source, g0, g1) LEFT JOIN ta USING (source, g0, g1)"


@query("context_words", CONTEXT)
def context_words(spark, d):
    """The eight words on either side of each gap of a labeller's stream."""
    w = words(spark, d)
    return segment.context_words(w, segment.gaps_between_words(w), 8)


#: Phrases of the split, labels where views begin; a fold over the phrases, one by one.
SPEECH_WINDOWS = SPLIT.replace(" SELECT source::VARCHAR AS source, s AS start", """, lb AS (SELECT source, floor(s * 1000)::BIGINT AS ms, CASE floor(s * 1000)::BIGINT % 7 WHEN 0 THEN 'whispering' WHEN 1 THEN 'kissing' WHEN 2 THEN 'licking' WHEN 3 THEN 'breathing' WHEN 4 THEN 'tapping' WHEN 5 THEN 'breathing' ELSE 'moaning' END AS label FROM wd WHERE word = 'view'),
 ph AS (SELECT source, s, e, text, row_number() OVER v AS k, lag(e) OVER v AS pe, s - lag(e) OVER v AS gap FROM x WHERE kind = 'speech' WINDOW v AS (PARTITION BY source ORDER BY s, e, text)),
 hit AS (SELECT ph.source, k, ms, label, CASE label WHEN 'kissing' THEN 'oral sounds' WHEN 'licking' THEN 'oral sounds' WHEN 'breathing' THEN 'breathing' WHEN 'moaning' THEN 'moaning' END AS name FROM ph JOIN lb ON lb.source = ph.source AND ms >= pe * 1000 - 50 AND ms < ph.s * 1000 WHERE gap >= 0.7),
 vt AS (SELECT source, k, arg_max(name, (n, -ms)) AS name FROM (SELECT source, k, name, count(*) AS n, min(ms) AS ms FROM hit WHERE name IS NOT NULL GROUP BY ALL) GROUP BY ALL), sp AS (SELECT DISTINCT source, k FROM hit WHERE label = 'whispering'),
 g AS (SELECT ph.*, sp.k IS NOT NULL AS spoken, CASE WHEN gap >= 0.7 THEN coalesce('[' || name || ']', printf('[pause %.1fs]', greatest(0.5, round_even(gap * 2, 0) / 2))) END AS tag, 2.0 + ('0x' || substr(md5(ph.source || '|0|' || floor(s * 1000)::BIGINT), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 18.0 AS len FROM ph LEFT JOIN vt USING (source, k) LEFT JOIN sp USING (source, k)),
 h(source, k, a, b, len, t, shut) AS (SELECT DISTINCT source, 0::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, []::VARCHAR[], NULL::STRUCT(a DOUBLE, b DOUBLE, t VARCHAR[], dead BOOLEAN) FROM g UNION ALL
  SELECT h.source, g.k, CASE WHEN h.a IS NULL OR gap > 6 OR g.e - h.a > h.len OR spoken THEN g.s ELSE h.a END, g.e, CASE WHEN h.a IS NULL OR gap > 6 OR g.e - h.a > h.len OR spoken THEN g.len ELSE h.len END,
   CASE WHEN h.a IS NULL OR gap > 6 OR g.e - h.a > h.len OR spoken THEN [g.text] WHEN g.tag IS NULL THEN list_append(h.t, g.text) ELSE list_concat(h.t, [g.tag, g.text]) END,
   CASE WHEN h.a IS NOT NULL AND (gap > 6 OR g.e - h.a > h.len OR spoken) THEN {'a': h.a, 'b': h.b, 't': h.t, 'dead': NOT (gap > 6 OR g.e - h.a > h.len)} END FROM h JOIN g ON g.source = h.source AND g.k = h.k + 1),
 w AS (SELECT source, unnest(shut) FROM h WHERE shut IS NOT NULL UNION ALL SELECT source, a, b, t, FALSE FROM (SELECT source, a, b, t, row_number() OVER (PARTITION BY source ORDER BY k DESC) AS z FROM h) WHERE z = 1 AND a IS NOT NULL),
 tx AS (SELECT *, array_to_string(t, ' ') AS text FROM w), r AS (SELECT *, CASE WHEN dead THEN 'speech in a gap' WHEN b - a NOT BETWEEN 2 AND 20 THEN 'length' WHEN regexp_matches(' ' || replace(regexp_replace(text, '\\[[^ ]*', '', 'g'), '  ', ' ') || ' ', ' (click click click click|error error error error|purchase purchase purchase purchase|signup signup signup signup|view view view view) ') THEN 'looped' WHEN len(string_split(text, ' ')) > 12 THEN 'too many words' ELSE 'kept' END AS reason FROM tx)
 SELECT source || '_' || lpad(floor(a * 1000)::BIGINT::VARCHAR, 9, '0') AS uid, text, a >= 4 AS prompted, reason FROM r --""")


@query("speech_windows", SPEECH_WINDOWS)
def speech_windows(spark, d):
    """Windows of each labeller's phrases with gap verdicts, and why some go."""
    w = words(spark, d)
    rec = segment.words_to_alignment(w).groupBy("source").agg(F.collect_list(F.struct("type", "start", "end", "word")).alias("e"))
    phrases = segment.split_alignment(rec, "e").filter("kind = 'speech'").select("source", "start", "end", "text")
    ms = F.floor(F.col("start") * 1000)
    heard = F.get(F.array(*map(F.lit, ("whispering", "kissing", "licking", "breathing", "tapping", "breathing", "moaning"))), (ms % 7).cast("int"))
    labels = w.filter("word = 'view'").select("source", ms.alias("ms"), heard.alias("label"))
    return windows.speech_windows(phrases, labels, most_words=12).select("uid", "text", F.col("prompt_start").isNotNull().alias("prompted"), "reason")
