"""Answers, updates and orders over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import answers as N
from quillon.operators import agreement, fusion, relations, sample, screen, segment
from quillon.plans.agreement_queries import EV, r6
from quillon.plans.registry import query
from quillon.sources import sinks
from quillon.sources.shared import scratch
from quillon.sources.tables import events, table
from quillon.streaming import jobs

MENU = ("brand#1", "brand#2", "brand#3", "economy", "brass")


@query(
    "answer_labels",
    "WITH a AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Sure! {\"labels\": [\"' || upper(p_brand) || '\", \" ' || p_type || '\", \"none\"]}' || chr(10) || 'Done.' WHEN 1 THEN '{\"labels\": [\"' || p_brand || '\"' WHEN 2 THEN 'I hear ' || p_brand ELSE '{\"labels\": \"' || p_brand || '\"}' END AS t, lower(p_brand) AS b, lower(p_type) AS y FROM part) "
    "SELECT id, array_to_string(CASE WHEN id % 4 = 0 THEN list_filter([b, y], lambda x: x IN ('brand#1', 'brand#2', 'brand#3', 'economy', 'brass')) ELSE [] END, ',') AS labels FROM a",
)
def answer_labels(spark, d):
    k, brand = F.col("p_partkey"), F.col("p_brand")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit('Sure! {"labels": ["'), F.upper(brand), F.lit('", " '), "p_type", F.lit('", "none"]}\nDone.')))
        .when(k % 4 == 1, F.concat(F.lit('{"labels": ["'), brand, F.lit('"')))
        .when(k % 4 == 2, F.concat(F.lit("I hear "), brand))
        .otherwise(F.concat(F.lit('{"labels": "'), brand, F.lit('"}')))
    )
    return table(spark, d, "part").select(k.alias("id"), F.array_join(N.answer_labels(text, MENU), ",").alias("labels"))


@query("usable_answers", "SELECT event_id FROM events WHERE event_type <> 'error' AND user_id % 7 <> 0 AND user_id % 5 <> 1")
def usable_answers(spark, d):
    e = events(spark, d)
    rows = e.select("event_id", F.when(F.col("who") % 5 != 1, F.col("who").cast("string")).alias("uid"), F.when(F.col("label") == "error", "ERROR: 429").otherwise(F.col("label")).alias("raw"), F.when(F.col("who") % 2 == 0, F.col("who") % 7 == 0).otherwise(F.when(F.col("who") % 7 == 0, True)).alias("skipped"))
    return N.usable(rows).select("event_id")


@query("after_intro", "SELECT event_id FROM events WHERE user_id % 3 <> 0 AND value >= 30")
def after_intro(spark, d):
    rows = events(spark, d).select("event_id", F.when(F.col("who") % 3 != 0, F.col("value")).alias("start"))
    return N.after_intro(rows).select("event_id")


@query(
    "judges_agree",
    f"WITH {EV}, p AS (SELECT item, label, avg((value > 50)::INT) AS p FROM ev GROUP BY 1, 2), t AS (SELECT event_id AS id, item, CASE label WHEN 'signup' THEN 'view' ELSE label END AS c FROM ev) SELECT id, c AS title_class, CASE WHEN p IS NULL THEN 'not fused or off the menu' WHEN p < 0.5 THEN 'judges disagree with the name' ELSE 'tier 3' END AS why FROM t LEFT JOIN p ON t.item = p.item AND t.c = p.label AND p.item % 4 > 0",
)
def judges_agree(spark, d):
    e = events(spark, d)
    p = e.groupBy(F.col("item").alias("uid"), "label").agg(F.avg((F.col("value") > 50).cast("int")).alias("p"))
    fused = p.filter("uid % 4 > 0").groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("label", "p"))).alias("probs"))
    return N.judges_agree(e.select(F.col("event_id").alias("id"), F.col("item").alias("uid"), "label"), fused, {"signup": "view"}).select("id", "title_class", "why")


@query(
    "majority_labels",
    "WITH v AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS who, unnest([l_returnflag, l_linestatus]) AS x, unnest(range(2)) AS i, l_partkey FROM lineitem), n AS (SELECT l_orderkey AS k, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1), f AS (SELECT k, who, x, i FROM (SELECT *, row_number() OVER (PARTITION BY k, who, i ORDER BY l_partkey, x) AS r FROM v) WHERE r = 1), c AS (SELECT k, x, count(*) AS c FROM (SELECT DISTINCT k, who, x FROM f) GROUP BY 1, 2) "
    "SELECT n.k AS k, coalesce(string_agg(x, ',' ORDER BY x) FILTER (WHERE 2 * c >= n), '') AS labels FROM n JOIN c ON n.k = c.k GROUP BY n.k",
)
def majority_labels(spark, d):
    l = table(spark, d, "lineitem")
    first = lambda c: F.min_by(c, F.struct("l_partkey", c))
    one = l.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("who")).agg(first("l_returnflag").alias("a"), first("l_linestatus").alias("b"))
    maps = one.groupBy("k").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("who").cast("string"), F.array_distinct(F.array("a", "b")))))).alias("people"))
    return maps.select("k", F.array_join(N.majority_labels(F.col("people")), ",").alias("labels"))


@query("span_labels", f"WITH {EV}, s AS (SELECT item, list(label) AS l, max(value) > 99 AS more FROM ev WHERE value > 80 GROUP BY item) SELECT item, array_to_string(list_sort(list_distinct(list_concat(l, CASE WHEN more THEN ['something else'] ELSE [] END))), ',') AS labels FROM s")
def span_labels(spark, d):
    s = events(spark, d).filter("value > 80").groupBy("item").agg(F.collect_list(F.struct("label", F.col("value").alias("start_ms"))).alias("spans"), F.when(F.max("value") > 99, " a squeak ").otherwise("  ").alias("other"))
    return s.select("item", F.array_join(N.span_labels(F.col("spans"), F.col("other")), ",").alias("labels"))


@query(
    "class_boost",
    "SELECT p_partkey AS id, CASE WHEN p_size % 3 > 0 AND (p_brand = 'Brand#1' OR p_type = 'BRASS') THEN 0.5 WHEN CASE p_type WHEN 'STEEL' THEN 'TIN' ELSE p_type END IN ('TIN', 'Brand#3') OR (p_size % 2 = 0 AND p_brand IN ('TIN', 'Brand#3')) OR (p_size % 3 > 0 AND p_brand IN ('TIN', 'Brand#3')) THEN 0.3 ELSE 0.0 END::DOUBLE AS boost FROM part",
)
def class_boost(spark, d):
    p = table(spark, d, "part")
    tags = F.when(F.col("p_size") % 3 > 0, F.array("p_brand", "p_type"))
    unsure = F.when(F.col("p_size") % 2 == 0, F.array("p_brand"))
    return p.select(F.col("p_partkey").alias("id"), N.class_boost(F.col("p_type"), unsure, tags, ["Brand#1", "BRASS"], ["TIN", "Brand#3"], {"STEEL": "TIN"}).alias("boost"))


@query("pair_members", "WITH h AS (SELECT o_orderkey AS id, o_custkey AS a, CASE WHEN o_orderkey % 9 = 0 THEN o_custkey ELSE (o_custkey * 7 + o_orderkey) % 1500 END AS b FROM orders) SELECT h.id AS pair, c_custkey AS clip, c_name AS name FROM h JOIN customer ON c_custkey IN (a, b)")
def pair_members(spark, d):
    k = F.col("o_custkey")
    pairs = table(spark, d, "orders").select(F.col("o_orderkey").alias("pair"), k.alias("a"), F.when(F.col("o_orderkey") % 9 == 0, k).otherwise((k * 7 + F.col("o_orderkey")) % 1500).alias("b"))
    clips = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return N.members(pairs, clips).select("pair", F.col("member.id").alias("clip"), F.col("member.name").alias("name"))


@query(
    "update_from_records",
    "WITH r AS (SELECT p_partkey AS uid, CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS tag FROM part), n AS (SELECT p_partkey AS uid, arg_max(CASE WHEN p_size % 4 > 0 THEN p_brand ELSE p_type END, (p_size, 0)) AS tag FROM part WHERE p_partkey % 3 = 0 GROUP BY 1) SELECT r.uid, CASE WHEN n.uid IS NULL THEN r.tag ELSE n.tag END AS tag, n.uid IS NOT NULL AND n.tag IS DISTINCT FROM r.tag AS changed FROM r LEFT JOIN n USING (uid)",
)
def update_from_records(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("uid"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_brand")).alias("tag"))
    new = F.when(F.col("p_size") % 4 > 0, F.col("p_brand")).otherwise(F.col("p_type"))
    older = F.struct(F.col("p_partkey").alias("uid"), F.lit("older").alias("tag"))
    patches = p.filter("p_partkey % 3 = 0").select(F.col("p_size").alias("seq"), F.to_json(F.array(older, F.struct(F.col("p_partkey").alias("uid"), new.alias("tag")))).alias("records"))
    return N.update_from_records(rows, patches, "uid", "tag", "string").select("uid", "tag", "changed")


@query("tied_ranks", "SELECT o_custkey AS who, count(*) AS labelled, rank() OVER (ORDER BY count(*) DESC) AS rank FROM orders GROUP BY 1")
def tied_ranks(spark, d):
    c = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("who")).agg(F.count(F.lit(1)).alias("labelled"))
    return N.tied_ranks(c, "labelled").select("who", "labelled", "rank")


@query(
    "worst_first",
    "WITH q AS (SELECT o_custkey AS who, count(*) AS answers, CASE count(*) % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'weak' WHEN 2 THEN 'too early' ELSE 'watch' END AS status, CASE WHEN o_custkey % 4 > 0 THEN (o_custkey % 10) / 10.0 END AS follow FROM orders GROUP BY 1) SELECT who, row_number() OVER (ORDER BY list_position(['weak', 'watch', 'too early', 'ok'], status), follow NULLS FIRST, answers DESC, who) AS place FROM q ORDER BY place LIMIT 300",
)
def worst_first(spark, d):
    """The first 300 labellers of the list, numbered."""
    from pyspark.sql import Window as W

    n = F.count(F.lit(1))
    q = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("who")).agg(n.alias("answers"))
    q = q.withColumns({"status": F.element_at(F.array(*map(F.lit, ("ok", "weak", "too early", "watch"))), (F.col("answers") % 4 + 1).cast("int")), "follow": F.when(F.col("who") % 4 > 0, (F.col("who") % 10) / 10.0)})
    key = [F.array_position(F.array(*map(F.lit, N.STATUSES)), F.col("status")), F.col("follow").asc_nulls_first(), F.col("answers").desc(), F.col("who")]
    top = q.orderBy(*key).limit(300)
    return top.withColumn("place", F.row_number().over(W.orderBy(*key))).select("who", "place")


@query("unanimous", f"WITH {EV}, e AS (SELECT item AS uid, who % 3 AS judge, max(label) AS vote FROM ev WHERE value > 97 GROUP BY 1, 2), t AS (SELECT uid, count(*) AS n, count(DISTINCT vote) AS v FROM e GROUP BY 1) SELECT uid, v = 1 AS unanimous, v AS answers FROM t WHERE n = 3")
def unanimous(spark, d):
    v = events(spark, d).filter("value > 97").select(F.col("item").alias("uid"), (F.col("who") % 3).alias("judge"), F.col("label").alias("vote"))
    return N.unanimous(v, 3).select("uid", "unanimous", F.size("votes").cast("long").alias("answers"))


@query("captions", "SELECT event_id, 'ASMR ' || i || ' ' || event_type || ', close-mic binaural, no speech' AS caption, '[' || i || '][' || event_type || ']' AS tag FROM (SELECT *, CASE WHEN value < 25 THEN 'soft' WHEN value < 50 THEN 'gentle' WHEN value < 78 THEN 'firm' ELSE 'vigorous' END AS i FROM events)")
def captions(spark, d):
    from quillon.functions.columns import intensity

    e = table(spark, d, "events").withColumn("i", intensity(F.col("value") / 100))
    return e.select("event_id", N.caption(F.col("i"), F.col("event_type")).alias("caption"), N.caption_tag(F.col("i"), F.col("event_type")).alias("tag"))


PLAN = {"ring": (r"ring\b", 3.0), "small": ("^small", 1.5)}


@query(
    "acquisition_plan",
    "WITH p AS (SELECT p_brand || p_size AS uploader, p_name AS title, CASE p_partkey % 3 WHEN 0 THEN 'f4a talk' WHEN 1 THEN 'male voice' ELSE 'other' END AS category, p_partkey % 9 AS minutes, p_partkey FROM part), q AS (SELECT *, CASE WHEN regexp_matches(upper(title), '\\b[FM][FM]?4') THEN upper(regexp_extract(upper(title), '\\b([FM])[FM]?4', 1)) WHEN regexp_matches(category, '^[fm]') THEN upper(category[1]) END AS v, lower(title) || ' tag' || (p_partkey % 4) AS text FROM p), r AS (SELECT *, CASE v WHEN 'F' THEN 'one' WHEN 'M' THEN 'two' ELSE '?' END AS route FROM q), "
    "m AS (SELECT uploader, route, row_number() OVER (PARTITION BY uploader ORDER BY count(*) DESC, route DESC) AS k FROM r GROUP BY 1, 2), s AS (SELECT uploader, count(*) AS posts_seen, CAST(sum(minutes) AS BIGINT) AS minutes_seen, count(*) FILTER (WHERE regexp_matches(text, 'ring\\b')) AS a, count(*) FILTER (WHERE regexp_matches(text, '^small')) AS b FROM r GROUP BY 1) SELECT uploader, posts_seen, minutes_seen, a + b AS matched, route, (a * 3.0 + b * 1.5)::DOUBLE AS score, least(posts_seen, 4) AS take_files FROM s JOIN m USING (uploader) WHERE k = 1 AND route <> '?' AND a + b >= 1 AND posts_seen >= 2",
)
def acquisition_plan(spark, d):
    k = F.col("p_partkey")
    category = F.element_at(F.array(*map(F.lit, ("f4a talk", "male voice", "other"))), (k % 3 + 1).cast("int"))
    posts = table(spark, d, "part").select(F.concat("p_brand", "p_size").alias("uploader"), F.col("p_name").alias("title"), F.array(F.concat(F.lit("tag"), k % 4)).alias("tags"), category.alias("category"), (k % 9).alias("minutes"))
    return N.acquisition_plan(posts, PLAN, "one", "two", 1, 2, 4).select("uploader", "posts_seen", "minutes_seen", F.col("matched").cast("long").alias("matched"), "route", "score", F.col("take_files").cast("long").alias("take_files"))


@query("recent_devices", "WITH r AS (SELECT o_custkey AS who, o_orderkey AS device, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderdate > TIMESTAMP '1998-07-01' - INTERVAL 30 DAY) SELECT who, device FROM r WHERE r <= 2")
def recent_devices(spark, d):
    """The two devices of each account that were used last, of those used within 30 days."""
    from pyspark.sql import Window as W

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("who"), F.col("o_orderkey").alias("device"), F.col("o_orderdate").alias("at"))
    live = N.recent(o, "at", F.lit("1998-07-01 00:00:00").cast("timestamp_ntz"), 30)
    return live.withColumn("r", F.row_number().over(W.partitionBy("who").orderBy(F.col("at").desc(), F.col("device").desc()))).filter("r <= 2").select("who", "device")


@query("source_prior_of", "WITH w AS (SELECT user_id AS source, CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.5 ELSE 0.0 END AS w FROM events WHERE user_id % 2 = 0) SELECT c_custkey AS source, round(coalesce((SELECT avg(w) FROM w WHERE w.source = c_custkey), (SELECT avg(w) FROM w)), 6) AS prior FROM customer")
def source_prior_of(spark, d):
    rows = events(spark, d).filter("who % 2 = 0").select(F.col("who").alias("source"), "label")
    return N.prior_of(rows, table(spark, d, "customer").select(F.col("c_custkey").alias("source")), {"click": 1.0, "view": 0.5}).select("source", r6("prior", "prior"))


@query("bytes_stored", "SELECT count(*) AS objects, CAST(sum(CASE WHEN p_partkey % 10 > 0 THEN p_size * 1000 END) AS BIGINT) AS bytes FROM part")
def bytes_stored(spark, d):
    meta = F.when(F.col("p_partkey") % 10 > 0, F.to_json(F.struct((F.col("p_size") * 1000).cast("string").alias("size")))).otherwise(F.lit("{}"))
    return N.bytes_stored(table(spark, d, "part").select(meta.alias("metadata")))


@query("speech_gate", f"WITH {EV}, s AS (SELECT who, sum(CASE WHEN label = 'view' THEN value ELSE 0 END) AS speech, sum(value) AS total FROM ev GROUP BY 1) SELECT who, round(speech, 4) AS speech, speech >= 20 AND speech >= 0.05 * total AS passed FROM s")
def speech_gate(spark, d):
    s = events(spark, d).select("who", F.lit(0.0).alias("start"), F.col("value").alias("end"), F.when(F.col("label") == "view", "speech").otherwise("gap").alias("kind"))
    return screen.speech_gate(s, source="who").select("who", F.round("speech", 4).alias("speech"), "passed")


@query("licence_filter", "SELECT doc_id FROM documents WHERE NOT regexp_matches(lower(coalesce(text, '')), 'by-nc|sampling\\+') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def licence_filter(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("licence"))
    return screen.licence_filter(docs, evals=table(spark, d, "labels").filter("quality = 0"), key="doc_id").select("doc_id")


@query(
    "stream_derived",
    "WITH l AS (SELECT user_id AS who, arg_max(event_type, (ts, event_id)) AS kind, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1) SELECT who, kind, round(0.5 * greatest(0.0, 1 - value / 50) + CASE WHEN kind = 'view' THEN 0.3 ELSE 0.0 END, 6) AS need FROM l",
)
def stream_derived(spark, d):
    """Derived columns kept up while rows change: each key's latest row with its columns computed anew."""
    from quillon.plans.curation_queries import event_stream

    changes = event_stream(spark, d).select(F.col("user_id").alias("who"), F.struct("ts", "event_id").alias("seq"), F.col("event_type").alias("kind"), "value")
    need = 0.5 * F.greatest(F.lit(0.0), 1 - F.col("value") / 50) + F.when(F.col("kind") == "view", 0.3).otherwise(0.0)
    kept = jobs.collected(jobs.derived(changes, "who", "seq", {"need": need}), "update")
    return jobs.latest(kept, ["who"]).select("who", "kind", r6("need", "need"))


#: An account's requests in order; its slots are (device, last seen), those unseen for thirty days go when a new device comes.
DEVICES = f"""WITH RECURSIVE {EV}, o AS (SELECT who, item % 4 AS device, tm AS t, row_number() OVER (PARTITION BY who ORDER BY tm, item % 4) AS i FROM ev),
 f(who, i, slots, device, t, allowed) AS (SELECT DISTINCT who, 0::BIGINT, []::STRUCT(d INT, seen TIMESTAMP)[], NULL::INT, NULL::TIMESTAMP, FALSE FROM o UNION ALL
  SELECT who, i, CASE WHEN ok THEN list_append(list_filter(s, lambda x: x.d <> device), {{'d': device, 'seen': t}}) ELSE s END, device, t, ok FROM (
   SELECT *, list_contains(list_transform(s, lambda x: x.d), device) OR len(s) < 2 AS ok FROM (SELECT f.who, o.i, o.device, o.t, CASE WHEN list_contains(list_transform(f.slots, lambda x: x.d), o.device) THEN f.slots ELSE list_filter(f.slots, lambda x: x.seen >= o.t - INTERVAL 3 DAY) END AS s FROM f JOIN o ON o.who = f.who AND o.i = f.i + 1)))
 SELECT who, device, t AS at, allowed FROM f WHERE i > 0"""


@query("stream_devices", DEVICES)
def stream_devices(spark, d):
    """Requests by device that an account may make: two devices at a time, a slot free after three days without use; in order of time, a file a week."""
    from quillon.sources.shared import scratch

    e = events(spark, d).select("who", (F.col("item") % 4).alias("device"), F.col("at").cast("timestamp").alias("at"))
    folder, check, out = (scratch(spark, f"devices-{x}") for x in ("in", "checkpoint", "out"))
    ends = e.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    told = None
    for part in range(3) if ends.a else range(1):
        third = F.floor(3 * (F.unix_micros("at") - F.unix_micros(F.lit(ends.a))) / (F.unix_micros(F.lit(ends.b)) - F.unix_micros(F.lit(ends.a)) + 1)) if ends.a else F.lit(0)
        e.filter(third == part).write.mode("append").parquet(folder)
        told = jobs.device_slots(jobs.follow(spark, folder, e.schema, "parquet"), days=3)
        jobs.run_available(told, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), check)
    return spark.read.schema(told.schema).parquet(out).select("who", "device", F.col("at").cast("timestamp_ntz").alias("at"), "allowed")


@query("vocabulary", "WITH t AS (SELECT unnest(['soft', lower(p_type), lower(p_brand)]) AS name FROM part) SELECT name, CASE WHEN name = 'soft' THEN 'intensity' ELSE 'trigger' END AS kind, count(*) AS n FROM t GROUP BY 1, 2")
def vocabulary(spark, d):
    t = F.concat(F.lit("[ Soft][ "), "p_type", F.lit("] some speech ["), "p_brand", F.lit("] [ ] more"))
    return segment.vocabulary(table(spark, d, "part").select(t.alias("transcript")))


@query("captions_by_name", "SELECT p_partkey AS id, coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_name END, 'a recording') AS caption FROM part")
def captions_by_name(spark, d):
    k = F.col("p_partkey")
    files = table(spark, d, "part").select(k.alias("id"), F.concat(F.lit("some/folder/"), k, F.lit(".flac")).alias("relpath"))
    named = table(spark, d, "part").filter(k % 3 > 0).select(F.concat(F.lit("other/"), k, F.lit(".flac")).alias("file_name"), F.col("p_name").alias("caption"))
    return relations.captions_by_name(files, named).select("id", "caption")


@query("expired", "SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= DATE '1998-07-01' - 180")
def expired(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    return sinks.expire(o, "at", 180, F.lit("1998-07-01").cast("date")).select("id")


@query("export_delta", "SELECT p_partkey AS id FROM part WHERE p_size % 4 > 0")
def export_delta(spark, d):
    """Rows that an index doesn't list, written and read again."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    out = scratch(spark, "delta")
    sinks.export_delta(p, p.filter("p_size % 4 = 0"), "id", out)
    return spark.read.schema("id long").json(out)


@query("stream_sliding", "WITH w AS (SELECT unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts - INTERVAL 12 HOUR) + INTERVAL 12 HOUR]) AS \"start\", event_type, value FROM events) SELECT \"start\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2")
def stream_sliding(spark, d):
    """Windows of a day every twelve hours. The files hold a month each in no order of time, so nothing may be late before that."""
    from quillon.plans.curation_queries import event_stream

    w = jobs.windowed(event_stream(spark, d), "at", "1 day", ["event_type"], "value", slide="12 hours", late="40 days")
    return jobs.latest(jobs.collected(w, "update"), ["start", "end", "event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sessions", "WITH l AS (SELECT user_id AS who, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT who, ts, sum(new) OVER (PARTITION BY who ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l) SELECT who, min(ts) AS \"start\", max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM s GROUP BY who, s")
def stream_sessions(spark, d):
    """Sessions of each labeller, six hours apart, as the last batch leaves them."""
    from quillon.plans.curation_queries import event_stream

    out = jobs.collected(jobs.sessions(event_stream(spark, d).withColumnRenamed("user_id", "who"), "at", "6 hours", "who", late="40 days"), "complete")
    last = out.filter(F.col("_batch") == out.agg(F.max("_batch")).first()[0])
    return last.select("who", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("held_out_pairs", "WITH t AS (SELECT l_orderkey AS uid, l_linenumber AS take, l_quantity AS score FROM lineitem), b AS (SELECT uid, min((score, take)) AS b FROM t GROUP BY uid), p AS (SELECT uid, b[2] AS chosen, take AS rejected FROM t JOIN b USING (uid) WHERE score - b[1] >= 20), u AS (SELECT uid, row_number() OVER (ORDER BY uid) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT uid FROM p)) SELECT uid, chosen, rejected, CASE WHEN r <= floor(n * 0.1) THEN 'held' ELSE 'train' END AS split FROM p JOIN u USING (uid)")
def held_out_pairs(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("take"), F.col("l_quantity").alias("score"))
    return sample.held_out(sample.preference_pairs(t, gap=20.0), 0.1).select("uid", "chosen", "rejected", "split")


@query("background_bags", "WITH r AS (SELECT l_orderkey AS bag, l_quantity AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT bag, any_value(n) AS n, round(avg(s), 6) AS score FROM r WHERE r <= 2 OR bag % 5 = 0 GROUP BY bag")
def background_bags(spark, d):
    return sample.bag_scores(table(spark, d, "lineitem"), "l_orderkey", "l_quantity", 2, F.col("l_orderkey") % 5 == 0).select(F.col("l_orderkey").alias("bag"), "n", r6("score", "score"))


@query("judge_agreement", f"WITH {EV}, g AS (SELECT item % 5 AS label, item, who % 3 AS judge, max(label) AS pred FROM ev WHERE value > 96 GROUP BY 1, 2, 3), r AS (SELECT a.label, a.judge, b.judge AS j, avg((a.pred = b.pred)::INT) AS a FROM g a JOIN g b ON a.item = b.item AND a.judge < b.judge GROUP BY 1, 2, 3) SELECT label, count(*) AS pairs, round(avg(a), 6) AS agree FROM r GROUP BY label")
def judge_agreement(spark, d):
    g = events(spark, d).filter("value > 96").groupBy((F.col("item") % 5).alias("label"), "item", (F.col("who") % 3).alias("judge")).agg(F.max("label").alias("pred"))
    return agreement.judge_agreement(g).select("label", "pairs", r6("agree", "agree"))


@query("covered_cells", f"WITH {EV}, v AS (SELECT item, who % 4 AS w, list(DISTINCT label) AS labels FROM ev WHERE value > 90 GROUP BY 1, 2), c AS (SELECT item, w, labels, unnest(CASE WHEN w = 0 THEN ['click', 'view'] WHEN w = 1 THEN ['error'] ELSE ['click', 'error', 'view'] END) AS label FROM v) SELECT item, w AS labeller, label, list_contains(labels, label)::INT AS yes FROM c")
def covered_cells(spark, d):
    """Cells of votes where two of the labellers can tell some labels only."""
    v = events(spark, d).filter("value > 90").groupBy("item", (F.col("who") % 4).cast("string").alias("who")).agg(F.collect_set("label").alias("labels"))
    cells = fusion.vote_cells(v, ["click", "error", "view"], covers={"0": ["view", "click"], "1": ["error", "signup"]})
    return cells.select(F.col("uid").alias("item"), F.col("labeller").cast("int").alias("labeller"), "label", "yes")


@query("chapter_votes", "SELECT p_partkey AS id, array_to_string(CASE WHEN contains(lower(p_name), 'ring') THEN ['spraying'] WHEN CASE p_type WHEN 'STEEL' THEN 'TIN' ELSE p_type END IN ('TIN', 'BRASS') THEN [CASE p_type WHEN 'STEEL' THEN 'TIN' ELSE p_type END] WHEN p_type = 'ECONOMY' THEN [] END, ',') AS vote FROM part")
def chapter_votes(spark, d):
    v = fusion.chapter_vote(F.col("p_type"), F.col("p_name"), ["TIN", "BRASS"], {"STEEL": "TIN"}, {"ring": "spraying"}, "ECONOMY")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(v, ",").alias("vote"))


@query("predicted_seconds", "WITH t AS (SELECT p_partkey AS id, p_name || ' [pause ' || (p_size / 10.0)::DECIMAL(5, 1) || 's] and more [soft][pause] ' || p_name AS t, p_size, p_name FROM part) SELECT id, round((p_size / 10.0)::DECIMAL(5, 1)::DOUBLE + 3.0 + (2 * len(string_split(p_name, ' ')) + 2) / 2.6, 6) AS seconds FROM t")
def predicted_seconds(spark, d):
    t = F.concat("p_name", F.lit(" [pause "), (F.col("p_size") / 10.0).cast("decimal(5,1)").cast("string"), F.lit("s] and more [soft][pause] "), "p_name")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), r6(segment.predicted_seconds(t), "seconds"))
