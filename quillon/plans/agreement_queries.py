"""Agreement, quality and fusion over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import agreement as A
from quillon.operators import fusion, relations
from quillon.plans.registry import query
from quillon.sources.tables import CONTROL_ITEMS, LABELS, answers, events, table, votes

EV = "ev AS (SELECT event_id, ts AS tm, user_id AS who, CAST(json_extract_string(props, '$.k') AS INTEGER) AS item, event_type AS label, value FROM events)"
VOTES = EV + ", votes AS (SELECT item, who, list_sort(list(DISTINCT label)) AS labels, min(tm) AS tm, avg(value) AS value FROM ev GROUP BY item, who)"
ANS = EV + ", ans AS (SELECT *, row_number() OVER (PARTITION BY item, who ORDER BY tm, event_id) AS attempt FROM ev)"


def jac(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"


def r6(c, name: str):
    return F.round(c, 6).alias(name)


@query("clip_agreement", f"WITH {VOTES} SELECT v.item, any_value(n) AS answers, round(avg(j), 6) AS agreement FROM (SELECT item, count(*) AS n FROM votes GROUP BY item) v LEFT JOIN (SELECT a.item, {jac('a.labels', 'b.labels')} AS j FROM votes a JOIN votes b ON a.item = b.item AND a.who < b.who) p ON v.item = p.item GROUP BY v.item")
def clip_agreement(spark, d):
    return A.clip_agreement(votes(spark, d)).select("item", "answers", r6("agreement", "agreement"))


TRUST = "t AS (SELECT DISTINCT user_id AS who, (user_id % 10) / 10.0 AS trust, user_id % 40 AS evidence, user_id % 13 = 0 AS weak FROM events)"


@query("clip_consensus", f"""WITH {VOTES}, {TRUST}, c AS (SELECT v.item, v.labels, trust FROM votes v JOIN t USING (who) WHERE (evidence < 20 OR trust >= 0.15) AND NOT weak),
 tot AS (SELECT item, count(*) AS voters, sum(trust)::DOUBLE AS w FROM c GROUP BY item),
 lab AS (SELECT item, l, sum(trust)::DOUBLE AS wl FROM (SELECT item, trust, unnest(labels) AS l FROM c) GROUP BY item, l)
 SELECT tot.item, any_value(voters) AS voters, round(CASE WHEN any_value(voters) < 2 OR any_value(w) <= 0 THEN NULL ELSE coalesce(avg(abs(2 * wl / w - 1)), 1.0) END + 1e-9, 6) AS consensus FROM tot LEFT JOIN lab USING (item) GROUP BY tot.item""")
def clip_consensus(spark, d):
    t = table(spark, d, "events").select(F.col("user_id").alias("who")).distinct().select("who", ((F.col("who") % 10) / 10.0).alias("trust"), (F.col("who") % 40).alias("evidence"), (F.col("who") % 13 == 0).alias("weak"))
    return A.clip_consensus(votes(spark, d), t).select("item", "voters", r6(F.col("consensus") + 1e-9, "consensus"))


PEERS = """cnt AS (SELECT item, l, count(*) AS c FROM (SELECT item, unnest(labels) AS l FROM {v}) GROUP BY item, l), n AS (SELECT item, count(*) AS n FROM {v} GROUP BY item),
 ref AS (SELECT v.item, v.who, v.labels, v.tm, list_sort(coalesce(list(l) FILTER (WHERE c - list_contains(v.labels, l)::INT > 0 AND 2 * (c - list_contains(v.labels, l)::INT) >= n - 1), [])) AS reference FROM {v} v JOIN n USING (item) LEFT JOIN cnt USING (item) WHERE n - 1 >= {k} GROUP BY v.item, v.who, v.labels, v.tm)"""


@query("peer_reference", f"WITH {VOTES}, {PEERS.format(v='votes', k=2)} SELECT item, who, array_to_string(labels, ',') AS labels, array_to_string(reference, ',') AS reference FROM ref")
def peer_reference(spark, d):
    return A.peer_reference(votes(spark, d), 2).select("item", "who", F.array_join("labels", ",").alias("labels"), F.array_join("reference", ",").alias("reference"))


def timed_answers(spark, d):
    from pyspark.sql import Window as W

    a = answers(spark, d)
    gap = F.lag("at").over(W.partitionBy("who").orderBy("at", "event_id"))
    return a.select("item", "who", "attempt", F.array("label").alias("labels"), (F.col("event_id") % 7 == 0).alias("unsure"), (F.col("value") * 100).alias("listen_ms"), ((F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(gap.cast("timestamp"))) / 1e6).alias("answer_s"), "at")


TIMED = ANS + ", ta AS (SELECT item, who, attempt, [label] AS labels, event_id % 7 = 0 AS unsure, value * 100 AS listen_ms, (epoch_us(tm) - epoch_us(lag(tm) OVER (PARTITION BY who ORDER BY tm, event_id))) / 1e6 AS answer_s, tm FROM ans)"
TRUTH = f"truth AS (SELECT item, list_sort(list(l)) AS labels FROM (SELECT item, l, c, sum(c) OVER (PARTITION BY item) AS n, row_number() OVER (PARTITION BY item ORDER BY c DESC, l) AS r FROM (SELECT item, label AS l, count(*) AS c FROM ev WHERE item < {CONTROL_ITEMS} GROUP BY item, label)) WHERE r <= 2 GROUP BY item)"


def control_truth(spark, d):
    """The two most frequent labels of each control item."""
    from pyspark.sql import Window as W

    c = events(spark, d).filter(F.col("item") < CONTROL_ITEMS).groupBy("item", "label").agg(F.count(F.lit(1)).alias("c"))
    top = c.withColumn("r", F.row_number().over(W.partitionBy("item").orderBy(F.col("c").desc(), "label"))).filter("r <= 2")
    return top.groupBy("item").agg(F.array_sort(F.collect_list("label")).alias("labels"))


@query("labeller_trust", f"""WITH {TIMED}, {TRUTH}, f AS (SELECT * FROM ta WHERE attempt = 1), s AS (SELECT item, who, labels, tm FROM f WHERE NOT unsure), {PEERS.format(v='s', k=4)},
 e AS (SELECT who, 1.0 AS w, {jac('labels', 'reference')} AS j FROM ref UNION ALL SELECT s.who, 2.0, {jac('s.labels', 'truth.labels')} FROM s JOIN truth USING (item) UNION ALL SELECT f.who, 2.0, {jac('f.labels', 'g.labels')} FROM f JOIN ta g ON f.item = g.item AND f.who = g.who AND g.attempt = 2),
 sums AS (SELECT who, sum(w)::DOUBLE AS evidence, sum(w * j)::DOUBLE AS s FROM e GROUP BY who), l AS (SELECT who, quantile_cont(listen_ms, 0.5) AS listen FROM f GROUP BY who)
 SELECT l.who, coalesce(evidence, 0.0) AS evidence, round(least(greatest(least(greatest((coalesce(s, 0) + 2.5) / (coalesce(evidence, 0) + 5.0), 0.0), 1.0) * CASE WHEN listen < 2500 THEN 0.7 ELSE 1.0 END, 0.0), 1.0), 6) AS trust FROM l LEFT JOIN sums USING (who)""")
def labeller_trust(spark, d):
    t = timed_answers(spark, d)
    return A.trust(t.filter("attempt = 1"), t.filter("attempt = 2"), control_truth(spark, d)).select("who", "evidence", r6("trust", "trust"))


@query("labeller_quality", f"""WITH {TIMED}, {TRUTH}, f AS (SELECT * FROM ta WHERE attempt = 1), s AS (SELECT item, who, labels, tm FROM f WHERE NOT unsure), {PEERS.format(v='s', k=2)},
 refs AS (SELECT s.item, s.who, s.labels, s.tm, coalesce(truth.labels, ref.reference) AS reference FROM s LEFT JOIN truth USING (item) LEFT JOIN ref ON s.item = ref.item AND s.who = ref.who),
 num AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY tm DESC, item DESC) AS i FROM refs WHERE reference IS NOT NULL), win AS (SELECT *, count(*) OVER (PARTITION BY who) AS n FROM num WHERE i <= 400),
 sh AS (SELECT *, unnest(range(1, least(n - 1, 20) + 1)) AS k FROM win WHERE n > 1),
 cmp AS (SELECT a.who, a.i, {jac('a.labels', 'a.reference')} AS jm, {jac('a.labels', 'b.reference')} AS ju, {jac('a.reference', 'b.reference')} AS jr FROM sh a JOIN win b ON a.who = b.who AND b.i = ((a.i - 1 + a.k) % a.n) + 1),
 per AS (SELECT who, i, any_value(jm) AS jm, avg(ju) AS ju, avg(jr) AS jr FROM cmp GROUP BY who, i),
 fol AS (SELECT who, count(*) AS refs, avg(jm - ju) / greatest(0.1, 1 - avg(jr)) AS follow, coalesce(stddev_samp(jm - ju), 0) / sqrt(count(*)) / greatest(0.1, 1 - avg(jr)) AS se FROM per GROUP BY who),
 tim AS (SELECT who, avg((answer_s < 4)::INT) AS rush_rate, quantile_cont(listen_ms, 0.5) AS median_listen, coalesce(stddev_samp(answer_s), 0) / nullif(avg(answer_s), 0) AS cv FROM ta GROUP BY who),
 fi AS (SELECT who, count(*) AS answers, avg(unsure::INT) AS unsure_rate FROM f GROUP BY who), tp AS (SELECT who, max(c) AS top FROM (SELECT who, labels, count(*) AS c FROM f GROUP BY who, labels) GROUP BY who),
 rt AS (SELECT f.who, count(*) AS retests, avg({jac('f.labels', 'g.labels')}) AS ra FROM f JOIN ta g ON f.item = g.item AND f.who = g.who AND g.attempt = 2 GROUP BY f.who),
 al AS (SELECT fi.*, coalesce(refs, 0) AS refs, follow, se, rush_rate, median_listen, cv, top::DOUBLE / answers AS top_share, coalesce(retests, 0) AS retests, ra FROM fi LEFT JOIN fol USING (who) LEFT JOIN tim USING (who) LEFT JOIN tp USING (who) LEFT JOIN rt USING (who)),
 fl AS (SELECT *, coalesce(refs >= 15 AND follow + 1.645 * se < 0.1, FALSE) AS f1, coalesce(refs >= 15 AND follow < 0.1 AND NOT (follow + 1.645 * se < 0.1), FALSE) AS f2, coalesce(answers >= 20 AND rush_rate > 0.3, FALSE) AS f3, coalesce(answers >= 20 AND median_listen < 3000, FALSE) AS f4,
  coalesce(answers >= 30 AND cv < 0.15, FALSE) AS f5, coalesce(answers >= 20 AND top_share > 0.85, FALSE) AS f6, coalesce(retests >= 5 AND ra < 0.3, FALSE) AS f7, coalesce(answers >= 20 AND unsure_rate > 0.5, FALSE) AS f8 FROM al)
 SELECT who, answers, refs, round(follow + 1e-9, 6) AS follow, round(se, 6) AS se, round(rush_rate, 6) AS rush_rate, round(median_listen, 6) AS median_listen, round(cv, 6) AS cv, round(top_share, 6) AS top_share, retests, round(ra, 6) AS retest_agreement,
  f1::INT + f2::INT + f3::INT + f4::INT + f5::INT + f6::INT + f7::INT + f8::INT AS n_flags, CASE WHEN f1 OR f1::INT + f2::INT + f3::INT + f4::INT + f5::INT + f6::INT + f7::INT + f8::INT >= 2 THEN 'weak' WHEN f1::INT + f2::INT + f3::INT + f4::INT + f5::INT + f6::INT + f7::INT + f8::INT = 1 THEN 'watch' WHEN refs < 15 THEN 'too early' ELSE 'ok' END AS status FROM fl""")
def labeller_quality(spark, d):
    q = A.labeller_quality(timed_answers(spark, d), control_truth(spark, d))
    return q.select("who", "answers", "refs", r6(F.col("follow") + 1e-9, "follow"), *(r6(c, c) for c in ("se", "rush_rate", "median_listen", "cv", "top_share")), "retests", r6("retest_agreement", "retest_agreement"), F.size("flags").alias("n_flags"), "status")


@query("multilabel_scores", f"""WITH {VOTES}, {PEERS.format(v='votes', k=2)}, p AS (SELECT len(list_intersect(labels, reference)) AS tp, len(labels) AS y, len(reference) AS r, {jac('reference', 'labels')} AS j, labels = reference AS same FROM ref)
 SELECT count(*) AS n, round(sum(tp) / greatest(sum(y), 1), 6) AS precision, round(sum(tp) / greatest(sum(r), 1), 6) AS recall, round(2 * sum(tp) / greatest(sum(y) + sum(r), 1), 6) AS f1, round(avg((tp > 0)::INT), 6) AS any_overlap, round(avg(same::INT), 6) AS exact, round(avg(j), 6) AS mean_jaccard, round(avg(CASE WHEN y + r = 0 THEN 1.0 ELSE 2.0 * tp / (y + r) END), 6) AS mean_f1 FROM p""")
def multilabel_scores(spark, d):
    s = A.multilabel_scores(A.peer_reference(votes(spark, d), 2), "reference", "labels")
    return s.select("n", *(r6(c, c) for c in s.columns[1:]))


@query("per_class_scores", f"""WITH {VOTES}, {PEERS.format(v='votes', k=2)}, u AS (SELECT labels, reference, unnest(list_distinct(list_concat(labels, reference))) AS label FROM ref), s AS (SELECT label, count(*) FILTER (WHERE list_contains(labels, label) AND list_contains(reference, label)) AS tp, count(*) FILTER (WHERE list_contains(labels, label) AND NOT list_contains(reference, label)) AS fp, count(*) FILTER (WHERE NOT list_contains(labels, label) AND list_contains(reference, label)) AS fn FROM u GROUP BY label)
 SELECT label, tp, fp, fn, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1 FROM s""")
def per_class_scores(spark, d):
    s = A.per_class_scores(A.peer_reference(votes(spark, d), 2), "reference", "labels")
    return s.select("label", "tp", "fp", "fn", r6("precision", "precision"), r6("recall", "recall"), r6(2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1)), "f1"))


JUDGED = EV + ", jd AS (SELECT item * 1000 + day(tm) AS item, 'j' || (who % 4) AS judge, max(label) AS answer FROM ev GROUP BY 1, 2)"


def judged(spark, d):
    e = events(spark, d)
    return e.groupBy((F.col("item") * 1000 + F.day("at")).alias("item"), F.concat(F.lit("j"), (F.col("who") % 4).cast("string")).alias("judge")).agg(F.max("label").alias("answer"))


@query("cohen_kappa", f"""WITH {JUDGED}, c AS (SELECT a.judge AS judge_a, b.judge AS judge_b, a.answer AS x, b.answer AS y FROM jd a JOIN jd b ON a.item = b.item AND a.judge < b.judge), t AS (SELECT judge_a, judge_b, count(*) AS n, avg((x = y)::INT) AS po FROM c GROUP BY 1, 2),
 l AS (SELECT judge_a, judge_b, x AS k, count(*) AS l FROM c GROUP BY 1, 2, 3), r AS (SELECT judge_a, judge_b, y AS k, count(*) AS r FROM c GROUP BY 1, 2, 3), e AS (SELECT judge_a, judge_b, sum(l * r)::DOUBLE AS lr FROM l JOIN r USING (judge_a, judge_b, k) GROUP BY 1, 2)
 SELECT judge_a, judge_b, n, round(po, 6) AS agreement, round(CASE WHEN coalesce(lr, 0) / (n * n) < 1 THEN (po - coalesce(lr, 0) / (n * n)) / (1 - coalesce(lr, 0) / (n * n)) END, 6) AS kappa FROM t LEFT JOIN e USING (judge_a, judge_b)""")
def cohen_kappa(spark, d):
    return A.cohen_kappa(judged(spark, d)).select("judge_a", "judge_b", "n", r6("agreement", "agreement"), r6("kappa", "kappa"))


@query("class_gate", f"""WITH {EV}, g AS (SELECT CASE item % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'view' END AS label, 'j' || (who % 3) AS judge, label AS pred FROM ev),
 b AS (SELECT label, judge, avg((pred = label)::INT) AS hit FROM g GROUP BY 1, 2), m AS (SELECT label, count(*) AS judges, avg(hit) AS hit FROM b GROUP BY 1),
 w AS (SELECT label, pred, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, pred) AS r FROM g WHERE pred <> label GROUP BY label, pred), t AS (SELECT label, string_agg(pred, ',' ORDER BY r) AS wrong_answers FROM w WHERE r <= 3 GROUP BY label)
 SELECT label, judges, round(hit, 6) AS hit, CASE WHEN hit >= 0.205 THEN 'ADMIT' WHEN hit >= 0.195 THEN 'WEAK' ELSE 'REJECT' END AS verdict, wrong_answers FROM m LEFT JOIN t USING (label)""")
def class_gate(spark, d):
    e = events(spark, d)
    g = e.select(F.element_at(F.array(*map(F.lit, LABELS)), F.col("item") % 5 + 1).alias("label"), F.concat(F.lit("j"), (F.col("who") % 3).cast("string")).alias("judge"), F.col("label").alias("pred"))
    return A.class_gate(g, 0.205, 0.195).select("label", "judges", r6("hit", "hit"), "verdict", "wrong_answers")


@query("pair_preferences", "WITH p AS (SELECT least(l_partkey, l_suppkey) % 50 AS a, 50 + greatest(l_partkey, l_suppkey) % 20 AS b, l_quantity > 25 AS first FROM lineitem), g AS (SELECT a, b, count(*) AS judges, count(*) FILTER (WHERE first) AS wins_a FROM p GROUP BY a, b) SELECT a, b, judges, wins_a, CASE WHEN judges >= 3 THEN round(100 * greatest(wins_a, judges - wins_a) / judges) END AS agree_pct FROM g")
def pair_preferences(spark, d):
    p = table(spark, d, "lineitem").select((F.least("l_partkey", "l_suppkey") % 50).alias("a"), (50 + F.greatest("l_partkey", "l_suppkey") % 20).alias("b"), (F.col("l_quantity") > 25).alias("f"))
    return A.pair_preferences(p.select("a", "b", F.when(F.col("f"), F.col("a")).otherwise(F.col("b")).alias("pick")))


@query("fooled_percent", f"WITH {EV}, g AS (SELECT item, count(*) AS n, count(*) FILTER (WHERE (label = 'view') <> (value > 50)) AS wrong FROM ev GROUP BY item) SELECT item, n, CASE WHEN n >= 5 THEN round(100 * wrong / n) END AS fooled_pct FROM g")
def fooled_percent(spark, d):
    return A.fooled_percent(events(spark, d).select("item", (F.col("label") == "view").alias("truth"), (F.col("value") > 50).alias("guess")))


MARKS = "mk AS (SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'device' ELSE 'ip' END AS kind, CAST(o_orderkey // 3 AS VARCHAR) AS value, o_custkey AS who FROM orders)"


def marks(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.when(F.col("o_orderkey") % 2 == 0, "device").otherwise("ip").alias("kind"), F.floor(F.col("o_orderkey") / 3).cast("string").alias("value"), F.col("o_custkey").alias("who"))


@query("shared_marks", f"WITH {MARKS} SELECT kind, value, count(*) AS accounts, array_to_string(list_sort(list(CAST(who AS VARCHAR)))[1:20], ',') AS members FROM mk GROUP BY kind, value HAVING count(*) >= 2")
def shared_marks(spark, d):
    return A.shared_marks(marks(spark, d)).select("kind", "value", "accounts", F.array_join("members", ",").alias("members"))


@query("mark_members", f"WITH {MARKS} SELECT kind, value, count(*) OVER (PARTITION BY kind, value) AS accounts, who FROM mk QUALIFY count(*) OVER (PARTITION BY kind, value) >= 2")
def mark_members(spark, d):
    """Every account of every shared mark."""
    return A.mark_members(marks(spark, d))


@query("device_peers", f"WITH {MARKS} SELECT a.who, count(DISTINCT b.who) AS peers FROM mk a JOIN mk b ON a.kind = b.kind AND a.value = b.value AND a.who <> b.who GROUP BY a.who")
def device_peers(spark, d):
    return relations.shared_peers(marks(spark, d)).select("who", F.col("peers").cast("long").alias("peers"))


SCORED = EV + ", sc AS (SELECT event_id AS id, label, value AS score, item % 3 = 0 AS positive FROM ev)"


def scored(spark, d):
    return events(spark, d).select(F.col("event_id").alias("id"), "label", F.col("value").alias("score"), (F.col("item") % 3 == 0).alias("positive"))


@query("average_precision", f"WITH {SCORED}, r AS (SELECT label, positive, row_number() OVER w AS r, sum(positive::INT) OVER (PARTITION BY label ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS tp FROM sc WINDOW w AS (PARTITION BY label ORDER BY score DESC, id)) SELECT label, CAST(sum(positive::INT) AS BIGINT) AS positives, round(sum(CASE WHEN positive THEN tp / r ELSE 0 END) / greatest(sum(positive::INT), 1), 6) AS ap FROM r GROUP BY label")
def average_precision(spark, d):
    return A.average_precision(scored(spark, d)).select("label", "positives", r6("ap", "ap"))


@query("threshold_sweep", f"WITH {SCORED}, x AS (SELECT label, positive, score, unnest([10.0, 30.0, 50.0, 70.0, 90.0])::DOUBLE AS threshold FROM sc), s AS (SELECT label, threshold, count(*) FILTER (WHERE score >= threshold AND positive) AS tp, count(*) FILTER (WHERE score >= threshold AND NOT positive) AS fp, count(*) FILTER (WHERE positive) AS n FROM x GROUP BY 1, 2), b AS (SELECT label, max(CASE WHEN tp > 0 AND tp / greatest(tp + fp, 1) >= 0.33 THEN (tp / n, threshold) END) AS b FROM s GROUP BY label) SELECT label, b[2] AS threshold, round(b[1], 6) AS recall FROM b")
def threshold_sweep(spark, d):
    return A.threshold_sweep(scored(spark, d), [10.0, 30.0, 50.0, 70.0, 90.0], 0.33).select("label", "threshold", r6("recall", "recall"))


@query("vote_share", f"WITH {VOTES}, x AS (SELECT item, labels, unnest(CASE WHEN who % 2 = 0 THEN ['click', 'error', 'view'] ELSE ['purchase', 'signup', 'view'] END) AS label FROM votes) SELECT item, label, round(avg(list_contains(labels, label)::INT), 6) AS share FROM x GROUP BY item, label")
def vote_share(spark, d):
    v = votes(spark, d).withColumn("menu", F.when(F.col("who") % 2 == 0, F.array(*map(F.lit, ("click", "error", "view")))).otherwise(F.array(*map(F.lit, ("purchase", "signup", "view")))))
    return relations.vote_share(v, list(LABELS)).select("item", "label", r6("share", "share"))


CREW = "CASE WHEN who % 10 = 0 THEN CASE WHEN who % 20 = 0 THEN 10.0 ELSE 3.0 END END"
#: Both passes of 30 rounds: a round's posteriors are one list, by label and item; rates and evidence are sums over the cells.
FUSED = f"""WITH RECURSIVE {EV}, menu AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS label),
 v AS (SELECT item, who, list(DISTINCT label) AS labels, who % 3 AS part FROM ev GROUP BY item, who),
 c AS (SELECT item, who, label, list_contains(labels, label)::INT AS yes, {CREW} AS k FROM v CROSS JOIN menu WHERE (part <> 1 OR label IN ('click', 'error', 'purchase')) AND (item % 7 > 0 OR label <> 'view')),
 u AS (SELECT item, max((who % 10 = 0)::INT)::DOUBLE AS w FROM c GROUP BY item),
 cells AS MATERIALIZED (SELECT c.*, w FROM c JOIN u USING (item)),
 start AS (SELECT u.item, label, w, CASE WHEN count(k) > 0 THEN (sum(yes) FILTER (k IS NOT NULL) + 0.5) / (count(k) + 1) WHEN count(yes) > 0 THEN (sum(yes) + 0.5) / (count(yes) + 1) ELSE 0.1 END AS p
  FROM u CROSS JOIN menu LEFT JOIN (SELECT item, label, yes, k FROM c) x USING (item, label) GROUP BY ALL),
 em(r, item, label, w, p, pooled) AS (
  SELECT 0, item, label, w, p, NULL::STRUCT(who BIGINT, se DOUBLE, sp DOUBLE)[] FROM start
  UNION ALL (
  WITH now AS (SELECT r, item, label, w, CASE WHEN r = 30 THEN s.p ELSE em.p END AS p, pooled FROM em JOIN start s USING (item, label, w) WHERE r < 60),
   prior AS (SELECT label, (sum(w * p) + 1) / (sum(w) + 2) AS prior FROM now GROUP BY label),
   turn AS (SELECT max(r) AS r FROM now),
   pool AS (SELECT unnest(pooled, recursive := true) FROM (SELECT any_value(pooled) AS pooled FROM now)),
   n AS (SELECT label, who, any_value(k) AS k, sum(w * p * yes) AS tp, sum(w * (1 - p) * yes) AS fp, sum(w * p * (1 - yes)) AS fn, sum(w * (1 - p) * (1 - yes)) AS tn FROM cells JOIN now USING (item, label, w) GROUP BY label, who),
   f AS (SELECT label, who, k, tp + coalesce(0.8 * k, 20 * se, 0) AS tp, fn + coalesce(0.2 * k, 20 * (1 - se), 0) AS fn, tn + coalesce(0.95 * k, 20 * sp, 0) AS tn, fp + coalesce(0.05 * k, 20 * (1 - sp), 0) AS fp FROM n LEFT JOIN pool USING (who)),
   rates AS (SELECT label, who, k, prior, (tp + 1) / (tp + fn + 2) AS sens, (tn + 1) / (tn + fp + 2) AS spec FROM f JOIN prior USING (label)),
   means AS (SELECT list({{'who': who, 'se': se, 'sp': sp}}) AS pooled FROM (SELECT who, sum(prior * sens) / sum(prior) AS se, sum((1 - prior) * spec) / sum(1 - prior) AS sp FROM rates WHERE k IS NULL GROUP BY who)),
   said AS (SELECT item, label, sum(CASE yes WHEN 1 THEN ln(sens / (1 - spec)) ELSE ln((1 - sens) / spec) END) AS e FROM cells JOIN rates USING (label, who) GROUP BY item, label)
  SELECT turn.r + 1, item, label, w, 1 / (1 + exp(-greatest(-30.0, least(30.0, ln(prior / (1 - prior)) + coalesce(e, 0))))), CASE WHEN turn.r = 29 THEN means.pooled ELSE now.pooled END
  FROM now JOIN prior USING (label) LEFT JOIN said USING (item, label) CROSS JOIN turn CROSS JOIN means))
 SELECT item, label, round(p, 3) AS p, round(p, 3) > 0.5 AS chosen FROM em WHERE r = 60"""


@query("fuse_labels", FUSED)
def fuse_labels(spark, d):
    """Binary Dawid-Skene over all labellers; a tenth are persons, a third were asked about three labels, and on a seventh of the items nobody was asked about one."""
    e = events(spark, d)
    v = e.groupBy("item", "who").agg(F.collect_set("label").alias("labels"))
    few = F.array(*map(F.lit, LABELS[:3]))
    asked = F.when(F.col("who") % 3 == 1, few).otherwise(F.array(*map(F.lit, LABELS)))
    v = v.withColumn("menu", F.when(F.col("item") % 7 == 0, F.array_remove(asked, "view")).otherwise(asked))
    people = e.select("who").distinct().filter("who % 10 = 0").select(F.col("who").alias("labeller"), F.when(F.col("who") % 20 == 0, 10.0).otherwise(3.0).alias("k"))
    post, _ = fusion.fuse(fusion.vote_cells(v, list(LABELS), offered="menu"), people, rounds=30, menu=list(LABELS))
    return post.select(F.col("uid").alias("item"), F.explode("probs").alias("label", "p")).select("item", "label", "p", (F.col("p") > 0.5).alias("chosen"))


#: Fifty rounds over truth, weak label and answer; a round's posteriors are 216 rows.
JUDGES = f"""WITH RECURSIVE {EV}, names AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'other']) AS x),
 j AS (SELECT event_id AS uid, ['click', 'error', 'purchase', 'signup', 'view'][item % 5 + 1] AS label, label AS pred FROM ev),
 n AS (SELECT k.x AS k, a.x AS a, count(j.uid)::DOUBLE AS n FROM names k CROSS JOIN names a LEFT JOIN (SELECT * FROM j WHERE uid % 10 = 0) j ON j.label = k.x AND j.pred = a.x GROUP BY ALL),
 flat AS (SELECT k, a, CASE WHEN k = 'other' OR sum(n) OVER (PARTITION BY k) = 0 THEN 1 ELSE n END AS n FROM n), g0 AS (SELECT k, a, n / sum(n) OVER (PARTITION BY k) * 20 + 0.5 AS g FROM flat),
 pairs AS (SELECT l.x AS l, a.x AS a, count(j.uid)::DOUBLE AS n FROM names l CROSS JOIN names a LEFT JOIN j ON j.label = l.x AND j.pred = a.x GROUP BY ALL),
 first AS (SELECT k, l.x AS l, a, CASE WHEN k = l.x THEN 0.6::DOUBLE ELSE 0.08::DOUBLE END * g / sum(g) OVER (PARTITION BY k, l.x) AS p FROM g0 CROSS JOIN names l),
 em(r, k, l, a, p) AS (SELECT 1, k, l, a, p / sum(p) OVER (PARTITION BY l, a) FROM first UNION ALL (
  WITH w AS (SELECT r, k, l, a, p * n AS w FROM em JOIN pairs USING (l, a) WHERE r < 50), prior AS (SELECT k, sum(w) AS prior FROM w GROUP BY k),
   g1 AS (SELECT k, a, sum(w) + any_value(g) AS g FROM w JOIN g0 USING (k, a) GROUP BY k, a), g2 AS (SELECT k, a, g / sum(g) OVER (PARTITION BY k) AS g FROM g1),
   c1 AS (SELECT k, l, sum(w) + 0.5 AS c FROM w GROUP BY k, l), c2 AS (SELECT k, l, c / sum(c) OVER (PARTITION BY k) AS c FROM c1), q AS (SELECT k, l, a, prior * c * g AS p FROM prior JOIN g2 USING (k) JOIN c2 USING (k)), turn AS (SELECT max(r) AS r FROM w)
  SELECT turn.r + 1, k, l, a, p / sum(p) OVER (PARTITION BY l, a) FROM q CROSS JOIN turn)),
 best AS (SELECT l, a, max((p, k)) AS b, max(CASE WHEN k = l THEN p END) AS weak FROM em WHERE r = 50 GROUP BY l, a)
 SELECT uid, label, pred, b[2] AS fused, round(b[1], 6) AS conf, b[1] >= 0.8 AND b[2] <> 'other' AS confident, weak <= 0.1 AS hard_negative FROM j JOIN best ON l = label AND a = pred"""


@query("fuse_judges", JUDGES)
def fuse_judges(spark, d):
    """K-class Dawid-Skene with the calibrated judge: the events' labels against their items' habit."""
    e = events(spark, d)
    j = e.select(F.col("event_id").alias("uid"), F.element_at(F.array(*map(F.lit, LABELS)), F.col("item") % 5 + 1).alias("label"), F.col("label").alias("pred"))
    calibration = j.filter(F.col("uid") % 10 == 0).groupBy(F.col("label").alias("truth"), "pred").agg(F.count(F.lit(1)).alias("n"))
    return fusion.anchored_em(j, calibration, list(LABELS), rounds=50).withColumn("conf", F.round("conf", 6))


@query("merge_votes", f"WITH {EV}, u AS (SELECT item AS uid, who % 50 AS labeller, label, tm, event_id, 0 AS o FROM ev WHERE event_id % 2 = 0 UNION ALL SELECT item, who % 50, label, tm, event_id, 1 FROM ev WHERE event_id % 3 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY uid, labeller ORDER BY o DESC, tm DESC, event_id DESC) AS r FROM u) SELECT uid, labeller, label FROM r WHERE r = 1")
def merge_votes(spark, d):
    rows = events(spark, d).select(F.col("item").alias("uid"), (F.col("who") % 50).alias("labeller"), "label", F.struct("at", "event_id").alias("at"), "event_id")
    return fusion.merge_votes([rows.filter("event_id % 2 = 0"), rows.filter("event_id % 3 = 0")]).select("uid", "labeller", "label")
