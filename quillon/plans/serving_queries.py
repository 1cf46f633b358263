"""Serving and the working set over parts, customers, orders and their lines."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.operators import draws as D
from quillon.operators import working_set as S
from quillon.plans.registry import query
from quillon.sources.tables import table

NOW = datetime.datetime(1998, 1, 1)
_U = "(('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _chance(what: str, *keys: str) -> str:
    return _U.format(" || '|' || ".join(["'7'", f"'{what}'", *keys]))


#: What stands for clips, people, assignments and answers.
STATE = """c AS (SELECT p_partkey AS item, p_partkey % 13 > 0 AS active, (p_partkey % 17)::INT AS votes, 5 AS target, p_partkey % 31 = 0 AS gold, CASE WHEN p_partkey % 7 = 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS boost,
  p_retailprice / 2000 AS need, CASE p_partkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS voice, p_partkey % 4 = 0 AS nsfw, CASE WHEN p_partkey % 19 = 0 THEN 'control' ELSE 'unsure' END AS kind FROM part),
 p AS (SELECT c_custkey AS who, c_custkey % 400 AS n, CASE c_custkey % 9 WHEN 0 THEN 'weak' WHEN 1 THEN 'watch' WHEN 2 THEN 'ok' END AS status, CASE c_custkey % 5 WHEN 0 THEN 'speech' WHEN 1 THEN 'nonspeech' WHEN 2 THEN 'both' END AS sound_pref,
  CASE c_custkey % 7 WHEN 0 THEN 'sfw' WHEN 1 THEN 'nsfw' WHEN 2 THEN 'both' END AS content_pref, CASE c_custkey % 8 WHEN 0 THEN 'male' WHEN 1 THEN 'female' WHEN 2 THEN 'any' END AS voice_pref FROM customer),
 gv AS (SELECT o_custkey AS who, l_partkey AS item, 1 + (bool_or((l_partkey + o_custkey) % 5 = 0))::INT AS attempt, CASE WHEN max(o_orderkey) % 3 = 0 THEN 'open' ELSE 'done' END AS state, max(o_orderdate) AS assigned_at, max(o_orderdate) + INTERVAL 60 DAY AS expires_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
 lb AS (SELECT who, item, 1 AS attempt, row_number() OVER (PARTITION BY who ORDER BY assigned_at, item) AS seq, item % 6 = 0 AS unsure FROM gv WHERE state = 'done')"""


def state(spark, d):
    k, w = F.col("p_partkey"), F.col("c_custkey")
    pick = lambda c, m, *names: F.get(F.array(*(F.lit(x).cast("string") for x in (*names, *[None] * (m - len(names))))), (c % m).cast("int"))
    clips = table(spark, d, "part").select(
        k.alias("item"), (k % 13 > 0).alias("active"), (k % 17).cast("int").alias("votes"), F.lit(5).alias("target"), (k % 31 == 0).alias("gold"), F.when(k % 7 == 0, 0.25).otherwise(0.0).alias("boost"),
        (F.col("p_retailprice") / 2000).alias("need"), pick(k, 3, "male", "female").alias("voice"), (k % 4 == 0).alias("nsfw"), F.when(k % 19 == 0, "control").otherwise("unsure").alias("kind"),
    )
    people = table(spark, d, "customer").select(
        w.alias("who"), (w % 400).alias("n"), pick(w, 9, "weak", "watch", "ok").alias("status"), pick(w, 5, "speech", "nonspeech", "both").alias("sound_pref"),
        pick(w, 7, "sfw", "nsfw", "both").alias("content_pref"), pick(w, 8, "male", "female", "any").alias("voice_pref"),
    )
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey")).groupBy(F.col("o_custkey").alias("who"), F.col("l_partkey").alias("item"))
    given = lines.agg(
        (F.lit(1) + F.bool_or((F.col("l_partkey") + F.col("o_custkey")) % 5 == 0).cast("int")).alias("attempt"), F.when(F.max("o_orderkey") % 3 == 0, "open").otherwise("done").alias("state"),
        F.max("o_orderdate").alias("assigned_at"), (F.max("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("expires_at"),
    )
    order = W.partitionBy("who").orderBy("assigned_at", "item")
    labels = given.filter("state = 'done'").select("who", "item", F.lit(1).alias("attempt"), F.row_number().over(order).alias("seq"), (F.col("item") % 6 == 0).alias("unsure"))
    return clips, people, given, labels


_OK = "(coalesce(content_pref, 'both') = 'both' OR (content_pref = 'sfw' AND NOT nsfw) OR (content_pref = 'nsfw' AND nsfw)) AND (excl IS NULL OR voice IS NULL OR voice <> excl)"
#: Every person against every clip, step by step.
DRAWS = f"""WITH {STATE}, live AS (SELECT * FROM gv WHERE state = 'open' AND expires_at > TIMESTAMP '1998-01-01'),
 q AS (SELECT *, coalesce(status IN ('watch', 'weak'), FALSE) AS aud, {_chance("r", "who")} AS r, CASE WHEN coalesce(content_pref, '') = 'sfw' THEN NULL WHEN voice_pref = 'male' THEN 'female' WHEN voice_pref = 'female' THEN 'male' END AS excl,
  (SELECT count(*) FROM lb JOIN c USING (item) WHERE lb.who = p.who AND kind = 'control') AS controls FROM p),
 g AS (SELECT *, CASE WHEN aud THEN 15 ELSE least(300, greatest(30, n // 2)) END AS gap, CASE WHEN aud THEN 0.12 ELSE 0.04 END AS rep,
  CASE WHEN aud THEN greatest(0.05::DOUBLE, 0.25::DOUBLE - 0.01::DOUBLE * controls, 0.3::DOUBLE) ELSE greatest(0.05::DOUBLE, 0.25::DOUBLE - 0.01::DOUBLE * controls) END AS rate FROM q),
 ck AS (SELECT c.*, need + boost - 0.15::DOUBLE * coalesce(o, 0) + 0.05::DOUBLE * {_chance("jitter", "item")} AS fresh, {_chance("draw", "item")} AS u, votes > 0 AND votes < least(target, 3) AS started FROM c LEFT JOIN (SELECT item, count(*) AS o FROM live GROUP BY item) USING (item) WHERE active),
 pr AS (SELECT g.who, content_pref, excl, unnest(CASE WHEN sound_pref IN ('speech', 'nonspeech') THEN [sound_pref, 'any'] ELSE ['any'] END) AS sound, unnest(CASE WHEN sound_pref IN ('speech', 'nonspeech') THEN [0, 1] ELSE [0] END) AS si,
  CASE WHEN coalesce(content_pref, '') = 'sfw' OR coalesce(voice_pref, '') = 'female' THEN [FALSE] WHEN voice_pref = 'male' THEN [TRUE, FALSE] WHEN {_chance("male", "who")} < 0.3 THEN [TRUE, FALSE] ELSE [FALSE] END AS ms FROM g),
 pm AS (SELECT *, CASE WHEN sound = 'nonspeech' THEN [FALSE] ELSE ms END AS m2 FROM pr), px AS (SELECT who, content_pref, excl, sound, si, unnest(m2) AS male, unnest(range(len(m2))) AS mi FROM pm),
 ps AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY si, mi) - 1 AS i FROM px),
 fit AS (SELECT ps.who, i, ck.* FROM ps JOIN ck ON (voice = 'male' OR NOT male) AND (sound = 'any' OR (sound = 'speech') = (voice IS NOT NULL)) AND {_OK} WHERE NOT EXISTS (SELECT 1 FROM gv WHERE gv.who = ps.who AND gv.item = ck.item)),
 cand AS (SELECT who, i * 5 AS step, -votes::DOUBLE AS a, -need AS b, u AS cc, item, 1 AS attempt FROM fit WHERE gold AND votes < 12
  UNION ALL SELECT who, i * 5 + 1, -votes, -(need + boost), u, item, 1 FROM fit WHERE boost > 0 AND started UNION ALL SELECT who, i * 5 + 2, -fresh, 0, u, item, 1 FROM fit WHERE boost > 0
  UNION ALL SELECT who, i * 5 + 3, -votes, -(need + boost), u, item, 1 FROM fit WHERE started UNION ALL SELECT who, i * 5 + 4, -fresh, 0, u, item, 1 FROM fit
  UNION ALL SELECT g.who, -1, -need, 0, u, item, 1 FROM g JOIN ck ON kind = 'control' AND {_OK} WHERE r >= rep AND r < rep + rate AND NOT EXISTS (SELECT 1 FROM gv WHERE gv.who = g.who AND gv.item = ck.item)
  UNION ALL SELECT g.who, -2, 0, 0, {_chance("retest", "g.who", "lb.item")}, lb.item, 2 FROM g JOIN lb ON lb.who = g.who JOIN ck ON ck.item = lb.item WHERE n >= gap AND r < rep AND NOT unsure AND seq <= n - gap AND {_OK} AND NOT EXISTS (SELECT 1 FROM gv WHERE gv.who = g.who AND gv.item = lb.item AND gv.attempt = 2)
  UNION ALL SELECT live.who, -3, 0, 0, epoch_us(assigned_at), live.item, live.attempt FROM live JOIN ck USING (item) JOIN p ON p.who = live.who),
 best AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY step, a, b, cc, item) AS k FROM cand)
 SELECT who, item, attempt::INT AS attempt, step::INT AS step FROM best WHERE k = 1"""


@query("draws", DRAWS)
def draws(spark, d):
    """The next clip of every customer: open one, retest, control, then the passes."""
    clips, people, given, labels = state(spark, d)
    return D.draws(clips, people, given, labels, F.lit(NOW), seed=7)


SET = """c AS (SELECT o_orderkey AS item, o_orderkey % 5 > 1 AS active, o_custkey % 4 AS votes, 3 AS target, o_orderpriority AS batch, o_totalprice AS need, floor(o_totalprice)::BIGINT AS bytes, o_orderkey % 23 = 0 AS blocked,
  CASE WHEN o_orderkey % 3 = 0 THEN 'confident' ELSE 'unsure' END AS kind FROM orders), files AS (SELECT item, bytes FROM c WHERE item % 11 > 0), held AS (SELECT DISTINCT l_orderkey AS item FROM lineitem WHERE l_quantity > 45),
 nw AS (SELECT l_orderkey * 10 + l_linenumber AS key, -l_orderkey * 10 - l_linenumber AS item, floor(l_extendedprice)::BIGINT AS bytes FROM lineitem WHERE l_returnflag = 'R')"""
#: Budgets as shares of what is stored, so that they grow with the table.
WORKING_SET = f"""WITH {SET}, used AS (SELECT sum(bytes)::BIGINT AS u FROM c WHERE active),
 d1 AS (SELECT item, bytes, sum(bytes) OVER (ORDER BY need, item) AS s FROM c WHERE active AND votes = 0 AND batch LIKE '1%' AND item NOT IN (SELECT item FROM held)),
 down AS (SELECT item, bytes FROM d1, used WHERE s - bytes < u // 200), room AS (SELECT u // 50 + (SELECT coalesce(sum(bytes), 0) FROM down) AS r FROM used),
 b1 AS (SELECT c.item, f.bytes, sum(coalesce(f.bytes, 0)) OVER (ORDER BY votes > 0 DESC, need DESC, c.item) AS s FROM c LEFT JOIN files f USING (item) WHERE NOT active AND NOT blocked AND votes < target AND kind <> 'confident'),
 back AS (SELECT item, bytes FROM b1, room WHERE s <= r), r2 AS (SELECT r - (SELECT coalesce(sum(bytes), 0) FROM back) AS r FROM room),
 n1 AS (SELECT item, CASE WHEN key % 7 > 0 THEN bytes END AS bytes, sum(CASE WHEN key % 7 > 0 THEN bytes ELSE 0 END) OVER (ORDER BY key) AS s FROM nw), new AS (SELECT item, bytes FROM n1, r2 WHERE s <= r AND r > 0)
 SELECT item, 'down' AS action, bytes FROM down UNION ALL SELECT item, CASE WHEN bytes IS NULL THEN 'missing' ELSE 'back' END, bytes FROM back UNION ALL SELECT item, CASE WHEN bytes IS NULL THEN 'missing' ELSE 'new' END, bytes FROM new"""


@query("working_set", WORKING_SET)
def working_set(spark, d):
    """Orders as clips: those that go, come back and are added under a budget."""
    k = F.col("o_orderkey")
    clips = table(spark, d, "orders").select(
        k.alias("item"), (k % 5 > 1).alias("active"), (F.col("o_custkey") % 4).alias("votes"), F.lit(3).alias("target"), F.col("o_orderpriority").alias("batch"), F.col("o_totalprice").alias("need"),
        F.floor("o_totalprice").alias("bytes"), (k % 23 == 0).alias("blocked"), F.when(k % 3 == 0, "confident").otherwise("unsure").alias("kind"),
    )
    lines = table(spark, d, "lineitem")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    new = lines.filter("l_returnflag = 'R'").select((-key).alias("item"), key.alias("place"), F.floor("l_extendedprice").alias("bytes"))
    files = clips.filter("item % 11 > 0").select("item", "bytes").unionByName(new.filter("place % 7 > 0").select("item", "bytes"))
    used = clips.filter("active").agg(F.sum("bytes")).first()[0] or 0
    batch = clips.filter("batch LIKE '1%'").agg(F.max("batch")).first()[0]
    held = lines.filter("l_quantity > 45").select(F.col("l_orderkey").alias("item"))
    return S.working_set(clips, held, files, used + used // 50, used, used // 200, batch, new.select("item", "place"))
