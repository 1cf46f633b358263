"""Boards, snapshots, scalar functions and screens over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions import columns as X
from quillon.operators import board, relations, screen
from quillon.operators.order import running
from quillon.plans.agreement_queries import EV, r6
from quillon.plans.registry import CRC, CRC_TABLE, query
from quillon.sources import readers
from quillon.sources.tables import events, table

PEOPLE = "p AS (SELECT c_custkey AS who, c_name AS name, c_custkey % 4 = 0 AS guest, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS referred_by FROM customer)"


def people(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("who"), F.col("c_name").alias("name"), (F.col("c_custkey") % 4 == 0).alias("guest"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")).alias("referred_by"))


def orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("who"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"))


@query("leaderboard", f"WITH {PEOPLE}, c AS (SELECT o_custkey AS who, count(*) AS labelled, max(o_orderdate) AS last_at FROM orders GROUP BY 1) SELECT row_number() OVER (ORDER BY labelled DESC, last_at, name) AS rank, who, name, labelled, last_at FROM c JOIN p USING (who) ORDER BY rank LIMIT 50")
def leaderboard(spark, d):
    return board.leaderboard(orders(spark, d), people(spark, d), None)


@query("contributions", "WITH c AS (SELECT o_custkey AS who, CAST(o_orderdate + INTERVAL 9 HOUR AS DATE) AS day, count(*) AS labelled FROM orders GROUP BY 1, 2), f AS (SELECT * FROM c WHERE day > DATE '1998-06-01' - 371 AND day <= DATE '1998-06-01') SELECT who, day, labelled, CAST(least(4, ceil(4.0 * labelled / max(labelled) OVER (PARTITION BY who))) AS INT) AS level FROM f")
def contributions(spark, d):
    return board.contributions(orders(spark, d), "Asia/Tokyo", 371, "1998-06-01")


@query("queue_stats", "SELECT o_orderpriority AS batch, o_orderstatus AS kind, count(*) AS clips, count(*) FILTER (WHERE o_orderkey % 8 >= 3) AS complete, CAST(sum(o_orderkey % 8) AS BIGINT) AS votes, round(avg(greatest(0.0, 1 - (o_orderkey % 8) / 3.0)), 6) AS mean_need FROM orders GROUP BY 1, 2")
def queue_stats(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("batch"), F.col("o_orderstatus").alias("kind"), (F.col("o_orderkey") % 8).alias("votes"), F.lit(3).alias("target"))
    q = board.queue_stats(o.withColumn("need", F.greatest(F.lit(0.0), 1 - F.col("votes") / 3.0)))
    return q.withColumn("mean_need", F.round("mean_need", 6))


@query("inventory", "WITH b AS (SELECT p_brand AS label, p_type AS creator, count(*) AS n, sum(p_size) AS s FROM part GROUP BY 1, 2) SELECT label, CAST(sum(n) AS BIGINT) AS clips, round(sum(s) / 3600, 6) AS hours, count(*) AS creators, round(max(n) / sum(n), 6) AS top_share, CAST(greatest(0, 100 - sum(n)) AS BIGINT) AS deficit FROM b GROUP BY label")
def inventory(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("label"), F.col("p_type").alias("creator"), F.col("p_size").alias("seconds"))
    return board.inventory(p, target=100).select("label", "clips", r6("hours", "hours"), "creators", r6("top_share", "top_share"), F.col("deficit").cast("long").alias("deficit"))


@query("source_prior", f"WITH {EV} SELECT item AS source, count(*) AS n, round(avg(CASE label WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.5 ELSE 0.0 END), 6) AS prior FROM ev GROUP BY item")
def source_prior(spark, d):
    return board.source_prior(events(spark, d), {"purchase": 1.0, "signup": 0.5}, "item").select(F.col("item").alias("source"), "n", r6("prior", "prior"))


@query("progress", "SELECT (SELECT count(*) FROM customer) AS items, least((SELECT count(*) FROM customer), (SELECT count(DISTINCT o_custkey) FROM orders) + 5) AS labelled, (SELECT count(*) FROM orders) AS answers, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS labellers")
def progress(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderpriority").alias("who"))
    return board.progress(table(spark, d, "customer"), o, 5)


@query("mode_by", f"WITH {EV}, g AS (SELECT item, label, count(*) AS n, min(event_id) AS f FROM ev GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, f) AS r FROM g) SELECT item, label AS mode, n FROM r WHERE r = 1")
def mode_by(spark, d):
    return board.mode_by(events(spark, d), "item", "label", "event_id")


@query("confusion", "SELECT quality AS truth, toxic AS pred, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion(spark, d):
    return board.confusion(table(spark, d, "labels"), "quality", "toxic").select(F.col("quality").alias("truth"), F.col("toxic").alias("pred"), "n")


@query("shortfall", "SELECT p_brand AS label, count(*) FILTER (WHERE p_size % 2 = 0) AS n_0, count(*) FILTER (WHERE p_size % 2 = 1) AS n_1, greatest(0, 45 - count(*) FILTER (WHERE p_size % 2 = 0)) + greatest(0, 45 - count(*) FILTER (WHERE p_size % 2 = 1)) AS short FROM part GROUP BY 1")
def shortfall(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("label"), (F.col("p_size") % 2).alias("side"))
    return board.shortfall(p, [0, 1], 45).withColumn("short", F.col("short").cast("long"))


@query("referral_funnel", f"WITH {PEOPLE}, n AS (SELECT o_custkey AS who, count(*) AS n FROM orders GROUP BY 1) SELECT referred_by, count(*) AS people, count(*) FILTER (WHERE NOT guest) AS members, count(*) FILTER (WHERE guest) AS guests, count(n) AS labelling, CAST(coalesce(sum(n), 0) AS BIGINT) AS labels FROM p LEFT JOIN n USING (who) WHERE referred_by IS NOT NULL GROUP BY 1")
def referral_funnel(spark, d):
    return board.referral_funnel(people(spark, d), orders(spark, d))


@query("profile_ranks", f"WITH {PEOPLE}, c AS (SELECT o_custkey AS who, count(*) AS labelled FROM orders GROUP BY 1) SELECT who, name, labelled, CASE WHEN NOT guest THEN row_number() OVER (PARTITION BY guest ORDER BY labelled DESC, who) END AS rank FROM p JOIN c USING (who)")
def profile_ranks(spark, d):
    c = orders(spark, d).groupBy("who").agg(F.count(F.lit(1)).alias("labelled"))
    ranked = running(people(spark, d).join(c, "who"), [F.col("labelled").desc(), "who"], "guest", {"rank": F.lit(1)})
    return ranked.select("who", "name", "labelled", F.when(~F.col("guest"), F.col("rank")).alias("rank"))


@query("latest_devices", "WITH r AS (SELECT o_custkey AS who, o_orderkey AS device, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) SELECT who, device, r FROM r WHERE r <= 2")
def latest_devices(spark, d):
    r = F.row_number().over(W.partitionBy("who").orderBy(F.col("at").desc(), F.col("id").desc()))
    return orders(spark, d).withColumn("r", r).filter("r <= 2").select("who", F.col("id").alias("device"), "r")


@query("sequence_numbers", "SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def sequence_numbers(spark, d):
    w = W.partitionBy("who")
    return orders(spark, d).select("id", F.row_number().over(w.orderBy("at", "id")).alias("seq"), F.count(F.lit(1)).over(w).alias("n"))


@query("neediest", "WITH n AS (SELECT o_orderkey AS id, round((0.5 * greatest(0.0, 1 - (o_orderkey % 8) / 3.0) + 0.3 * coalesce(1 - CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 10) / 10.0 END, (o_orderkey % 7) / 7.0) + 0.2 * (o_orderkey % 7) / 7.0) * CASE WHEN o_orderkey % 8 >= 6 THEN 0.05 ELSE 1.0 END / (1 + o_orderkey % 3), 6) AS need FROM orders) SELECT id, need FROM n ORDER BY need DESC, id LIMIT 300")
def neediest(spark, d):
    k = F.col("id")
    conf = F.when(k % 5 > 0, (k % 10) / 10.0)
    n = X.need(k % 8, F.lit(3.0), F.lit(6), conf, (k % 7) / 7.0, k % 3)
    return orders(spark, d).select("id", r6(n, "need")).orderBy(F.col("need").desc(), "id").limit(300)


@query("uid_parts", "WITH u AS (SELECT doc_id, source || '/f' || doc_id || '.m4a_' || lpad(CAST(doc_id * 37 % 100000 AS VARCHAR), 9, '0') AS uid FROM documents) SELECT uid, regexp_replace(uid, '_\\d+$', '') AS recording, split_part(uid, '/', 1) AS creator, (doc_id * 37 % 100000) / 1000.0 AS start, regexp_replace(uid, '[^A-Za-z0-9_.\\-]', '_', 'g') AS safe FROM u")
def uid_parts(spark, d):
    uid = F.concat("source", F.lit("/f"), "doc_id", F.lit(".m4a_"), F.lpad((F.col("doc_id") * 37 % 100000).cast("string"), 9, "0"))
    u = table(spark, d, "documents").select(uid.alias("uid"))
    return u.select("uid", X.recording_of("uid").alias("recording"), X.creator_of(F.col("uid")).alias("creator"), X.start_of("uid").alias("start"), X.filename_safe(F.col("uid")).alias("safe"))


@query("label_sets", f"WITH {EV}, v AS (SELECT item, list_sort(list(DISTINCT label) FILTER (WHERE who % 2 = 0)) AS a, list_sort(list(DISTINCT label) FILTER (WHERE who % 3 = 0 AND value > 80)) AS b FROM ev GROUP BY item), w AS (SELECT item, coalesce(a, []) AS a, coalesce(b, []) AS b FROM v) SELECT item, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS f1 FROM w")
def label_sets(spark, d):
    v = events(spark, d).groupBy("item").agg(F.array_sort(F.collect_set(F.when(F.col("who") % 2 == 0, F.col("label")))).alias("a"), F.array_sort(F.collect_set(F.when((F.col("who") % 3 == 0) & (F.col("value") > 80), F.col("label")))).alias("b"))
    return v.select("item", r6(X.jaccard("a", "b"), "jaccard"), r6(X.set_f1("a", "b"), "f1"))


@query("probability_maps", f"WITH {EV}, p AS (SELECT item, label, avg((value > 50)::INT) AS p FROM ev GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY (label IN ('click', 'view')) DESC, p DESC, label DESC) AS r FROM p) SELECT item, round(max(1 - abs(2 * p - 1)), 6) AS uncertainty, max(label) FILTER (WHERE r = 1 AND label IN ('click', 'view')) AS hot, bool_or(p BETWEEN 0.4 AND 0.6) AS unsure, bool_and(p <= 0.3 OR p >= 0.7) AS decided FROM r GROUP BY item")
def probability_maps(spark, d):
    p = events(spark, d).groupBy("item", "label").agg(F.avg((F.col("value") > 50).cast("int")).alias("p"))
    m = p.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("label", "p"))).alias("m"))
    return m.select("item", r6(X.uncertainty("m"), "uncertainty"), X.argmax_key(F.col("m"), ["click", "view"]).alias("hot"), screen.uncertain_band(F.col("m"), 0.4, 0.6).alias("unsure"), screen.decided(F.col("m"), 0.3, 0.7).alias("decided"))


@query("embedding_similarity", "WITH c AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY 1), e AS (SELECT vec_id, label AS own, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings), d AS (SELECT vec_id, own, c.label, sum(x * m) / (sqrt(sum(x * x)) * any_value(n.n)) AS s FROM e JOIN c USING (i) JOIN n ON c.label = n.label GROUP BY 1, 2, 3) SELECT vec_id, round(max(s) FILTER (WHERE label = own), 5) AS positive, round(max(s) FILTER (WHERE label <> own), 5) AS negative FROM d GROUP BY 1")
def embedding_similarity(spark, d):
    """Similarity to the mean of the own class and the best other one; the class means are a short list in one row."""
    e = table(spark, d, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    classes = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    row = classes.agg(F.collect_list(F.struct("label", "mean")).alias("classes"))
    score = F.transform("classes", lambda c: F.struct((c["label"] == F.col("label")).alias("own"), X.cosine(F.col("embedding"), c["mean"]).alias("s")))
    best = lambda own: F.array_max(F.transform(F.filter("scores", lambda x: x["own"] == own), lambda x: x["s"]))
    return e.join(row).withColumn("scores", score).select("vec_id", F.round(best(True), 5).alias("positive"), F.round(best(False), 5).alias("negative"))


@query("half_even", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS rounded, CAST(trunc(l_extendedprice / 7 * 1000) AS BIGINT) AS truncated FROM lineitem")
def half_even(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 2, 0).alias("rounded"), (F.col("l_extendedprice") / 7 * 1000).cast("bigint").alias("truncated"))


@query("hash_buckets", f"WITH {CRC_TABLE}, k AS (SELECT source || '/' || doc_id AS key FROM documents), h AS (SELECT key, {CRC.format(k='key')} AS crc, list_transform(string_split(sha1(key), ''), lambda x: ('0x0' || x)::INT) AS d FROM k, crc_table) SELECT key, crc % 1000 AS crc, CAST((6 * list_sum(d[1:39]) + d[40]) % 10 AS INT) AS sha FROM h")
def hash_buckets(spark, d):
    """crc32 and SHA-1 buckets of the file names; tests compare with zlib and hashlib."""
    k = F.concat("source", F.lit("/"), "doc_id")
    return table(spark, d, "documents").select(k.alias("key"), X.crc_split(k, 1000).alias("crc"), X.sha1_mod10(k).alias("sha"))


BLOCK = "(?:trash|scum|worthless)"


@query("transcript_screen", f"WITH h AS (SELECT unnest(regexp_extract_all(lower(text), '{BLOCK}')) AS term FROM documents) SELECT 'toxic' AS screen, term, count(*) AS n FROM h GROUP BY term")
def transcript_screen(spark, d):
    return screen.term_counts(table(spark, d, "documents"), {"toxic": BLOCK})


@query("blocked_transcripts", f"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '{BLOCK}')) AS INT) AS hits, regexp_matches(lower(text), '{BLOCK}') AS blocked FROM documents")
def blocked_transcripts(spark, d):
    s = screen.transcript_screen(table(spark, d, "documents"), {"toxic": BLOCK})
    return s.select("doc_id", F.element_at("hits", "toxic").cast("int").alias("hits"), "blocked")


@query("exclusion_reasons", f"WITH r AS (SELECT CASE WHEN source = 'src3' THEN 'recording' WHEN doc_id % 11 = 0 THEN 'title' WHEN regexp_matches(lower(text), '{BLOCK}') THEN 'script' ELSE 'kept' END AS reason FROM documents) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def exclusion_reasons(spark, d):
    docs = table(spark, d, "documents")
    r = screen.first_reason(docs, [("recording", F.col("source") == "src3"), ("title", F.col("doc_id") % 11 == 0), ("script", F.lower("text").rlike(BLOCK))])
    return screen.reason_counts(r)


@query("title_screen", "SELECT page_id, regexp_matches(regexp_replace(lower(split_part(rtrim(split_part(split_part(url, '?', 1), '#', 1), '/'), '/', -1)), '[-_.]+', ' ', 'g'), '[13579]$') AS blocked_title FROM pages")
def title_screen(spark, d):
    p = table(spark, d, "pages").select("page_id", F.rtrim(F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), F.lit("/")).alias("path"))
    return screen.title_screen(p, "[13579]$").select("page_id", "blocked_title")


@query("training_rows", f"WITH {EV}, p AS (SELECT item, label, avg((value > 50)::INT) AS p FROM ev GROUP BY 1, 2), r AS (SELECT item AS uid, label, p AS w FROM p WHERE p >= 0.6 UNION ALL SELECT item, 'background', 1.0 FROM p GROUP BY item HAVING max(p) < 0.55), k AS (SELECT label FROM r GROUP BY label HAVING sum(w) >= 1) SELECT uid, label, round(w, 6) AS w FROM r WHERE label IN (SELECT label FROM k)")
def training_rows(spark, d):
    p = events(spark, d).groupBy("item", "label").agg(F.avg((F.col("value") > 50).cast("int")).alias("p"))
    m = p.groupBy(F.col("item").alias("uid")).agg(F.map_from_entries(F.collect_list(F.struct("label", "p"))).alias("probs"))
    return screen.training_rows(m, 0.6, 0.55).select("uid", "label", r6("w", "w"))


@query("cell_precision", f"WITH {EV}, j AS (SELECT who % 10 AS source, CASE item % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'view' END AS label, label AS pred, event_id AS uid FROM ev), c AS (SELECT source, label, avg((pred = label)::INT) AS w FROM j GROUP BY 1, 2 HAVING avg((pred = label)::INT) >= 0.2) SELECT source, label, uid, round(w, 6) AS w FROM j JOIN c USING (source, label)")
def cell_precision(spark, d):
    from quillon.sources.tables import LABELS

    j = events(spark, d).select((F.col("who") % 10).alias("source"), F.element_at(F.array(*map(F.lit, LABELS)), F.col("item") % 5 + 1).alias("label"), F.col("label").alias("pred"), F.col("event_id").alias("uid"))
    return screen.cell_precision(j, j.select("source", "label", "uid"), 0.2).select("source", "label", "uid", r6("w", "w"))


LOOPED = "WITH w AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\\[[^\\]]*\\]', ' ', 'g'), '\\s+'), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), lambda x: x <> '') AS ws FROM documents), u AS (SELECT rid, unnest(ws) AS x, unnest(range(len(ws))) AS i FROM w), g AS (SELECT rid, x, i - row_number() OVER (PARTITION BY rid, x ORDER BY i) AS g FROM u), r AS (SELECT DISTINCT rid FROM (SELECT rid, x, g FROM g GROUP BY rid, x, g HAVING count(*) > 3)) SELECT doc_id FROM w WHERE rid NOT IN (SELECT rid FROM r)"


@query("looped_text", LOOPED)
def looped_text(spark, d):
    """Documents without a word four times in a row."""
    return screen.looped(table(spark, d, "documents")).select("doc_id")


@query("benchmark_lines", "SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_lines(spark, d):
    """Documents that hold a benchmark passage in full, over any number of lines."""
    return screen.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("page_links", "SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages")
def page_links(spark, d):
    return readers.links(table(spark, d, "pages"))


@query("owner_map", "SELECT k, CASE WHEN k IN (SELECT o_custkey % 500 FROM orders WHERE o_orderkey % 2 = 0) THEN 'even' ELSE 'odd' END AS owner FROM (SELECT DISTINCT o_custkey % 500 AS k FROM orders)")
def owner_map(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 500).alias("k"), "o_orderkey")
    return relations.first_owner([("even", o.filter("o_orderkey % 2 = 0")), ("odd", o.filter("o_orderkey % 2 = 1"))], "k", "owner")


@query("fallback_values", "SELECT c_custkey AS k, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'first' WHEN b.v IS NOT NULL THEN 'second' END AS \"from\" FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a ON c_custkey = a.o_custkey LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders GROUP BY 1) b ON c_custkey = b.o_custkey")
def fallback_values(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice", "o_orderstatus")
    best = lambda x: x.groupBy("k").agg(F.max("o_totalprice").alias("v"))
    return relations.with_fallback(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), best(o.filter("o_orderstatus = 'F'")), best(o), "k", "v")


@query("upsert", "WITH n AS (SELECT s_suppkey + 50 AS k, s_name AS name, s_acctbal AS v FROM supplier), o AS (SELECT s_suppkey AS k, s_name AS name, s_acctbal AS v FROM supplier) SELECT coalesce(o.k, n.k) AS k, coalesce(o.name, n.name) AS name, coalesce(n.v, o.v) AS v FROM o FULL JOIN n ON o.k = n.k")
def upsert(spark, d):
    o = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("v"))
    return relations.upsert(o, o.withColumn("k", F.col("k") + 50), "k", ["name"])


@query("insert_ignore", "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT s_suppkey + 50, s_name FROM supplier WHERE s_suppkey + 50 NOT IN (SELECT s_suppkey FROM supplier)")
def insert_ignore(spark, d):
    o = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return relations.insert_ignore(o, o.withColumn("k", F.col("k") + 50), "k")


@query("violations", "SELECT 'size' AS \"check\", count(*) AS n FROM part WHERE NOT p_size <= 40 HAVING count(*) > 0 UNION ALL SELECT 'brand', count(*) FROM part WHERE NOT regexp_matches(p_brand, '1') HAVING count(*) > 0")
def violations(spark, d):
    return relations.violations(table(spark, d, "part"), {"size": F.col("p_size") <= 40, "brand": F.col("p_brand").rlike("1")})
