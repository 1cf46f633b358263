"""Joins with their own semantics: interval joins, as-of lookups, owner maps, tallies by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.sources.shared import cut


def interval_lookup(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, best: Column, tolerance: float = 0.05, bucket: float = 60.0) -> DataFrame:
    """Left join of points to the span of their key with start in [span start - tolerance, span end): the best one.

    Spans are laid out over time buckets, so the join is on (key, bucket) and a
    long recording is spread over many tasks. Adds ``span`` (struct of the span's
    columns, null if none).
    """
    number = lambda c: F.floor(c / bucket)
    others = [c for c in spans.columns if c != key]
    laid = spans.withColumn("_b", F.explode(F.sequence(number(F.col(start) - tolerance), number(F.col(end)))))
    right = laid.select(F.col(key).alias("_k"), "_b", F.struct(*others).alias("span"), best.alias("_o"))
    left = points.withColumn("_id", F.monotonically_increasing_id()).withColumn("_pb", number(F.col(at)))
    hit = (F.col(key) == F.col("_k")) & (F.col("_pb") == F.col("_b")) & (F.col(at) >= F.col(f"span.{start}") - tolerance) & (F.col(at) < F.col(f"span.{end}"))
    cols = points.columns
    return left.join(right, hit, "left").groupBy("_id").agg(*(F.first(c).alias(c) for c in cols), F.max_by("span", "_o").alias("span")).drop("_id")


def without_overlap(windows: DataFrame, spans: DataFrame, key: str, seconds: float, bucket: float = 60.0) -> DataFrame:
    """windows(key, start) of a fixed length that overlap no span(key, start, end) of their key: anti-join on (key, bucket)."""
    number = lambda c: F.floor(c / bucket)
    s = spans.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(F.sequence(number(F.col("start") - seconds), number(F.col("end")))).alias("_b"))
    hit = (F.col(key) == F.col("_k")) & (number(F.col("start")) == F.col("_b")) & (F.col("_s") < F.col("start") + seconds) & (F.col("start") < F.col("_e"))
    return windows.join(s, hit, "left_anti")


def contained(phrases: DataFrame, windows: DataFrame, key: str, slack: float = 0.01, bucket: float = 60.0) -> DataFrame:
    """(window columns, phrase columns as p_*) for phrases inside a window of the same key, within the slack."""
    number = lambda c: F.floor(c / bucket)
    w = windows.withColumn("_b", F.explode(F.sequence(number(F.col("start") - slack), number(F.col("end") + slack))))
    p = phrases.select(*(F.col(c).alias(f"p_{c}") for c in phrases.columns)).withColumn("_pb", number(F.col("p_start")))
    hit = (F.col(key) == F.col(f"p_{key}")) & (F.col("_b") == F.col("_pb")) & (F.col("p_start") >= F.col("start") - slack) & (F.col("p_end") <= F.col("end") + slack)
    return w.join(p, hit).drop("_b", "_pb")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the right side's latest value at or before its time: one union and one window, no range join."""
    from pyspark.sql import Window as W

    kind = right.schema[value].dataType
    l = left.withColumn("_v", F.lit(None).cast(kind)).withColumn("_side", F.lit(1))
    r = right.select(key, at, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    w = W.partitionBy(key).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, 0)
    return l.unionByName(r, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").drop("_v", "_side")


def first_owner(parts: list[DataFrame], key: str, name: str) -> DataFrame:
    """(key, owner): the first of the listed tables that has the key; parts are (owner, table)."""
    rows = None
    for i, (owner, df) in enumerate(parts):
        r = df.select(key).distinct().withColumns({"_o": F.lit(i), name: F.lit(owner)})
        rows = r if rows is None else rows.unionByName(r)
    return rows.groupBy(key).agg(F.min_by(name, "_o").alias(name))


def with_fallback(left: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """left with value from first, else from second, else null; and which it came from."""
    a = first.select(key, F.col(value).alias("_a"))
    b = second.select(key, F.col(value).alias("_b"))
    j = left.join(a, key, "left").join(b, key, "left")
    return j.withColumns({value: F.coalesce("_a", "_b"), "from": F.when(F.col("_a").isNotNull(), "first").when(F.col("_b").isNotNull(), "second")}).drop("_a", "_b")


def captions_by_name(files: DataFrame, captions: DataFrame, path: str = "relpath", name: str = "file_name", caption: str = "caption", fallback: str = "a recording") -> DataFrame:
    """files(relpath) with the caption of the same base name, the first by caption if several, else the fallback."""
    c = captions.select(F.regexp_extract(name, r"[^/]+$", 0).alias("_n"), caption).groupBy("_n").agg(F.min(caption).alias(caption))
    return files.withColumn("_n", F.regexp_extract(path, r"[^/]+$", 0)).join(c, "_n", "left").withColumn(caption, F.coalesce(caption, F.lit(fallback))).drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str] = ()) -> DataFrame:
    """new rows over old ones by key; columns in keep stay as they were for known keys. Rows only on one side stay."""
    o, n = old.select(F.col(key).alias("_ok"), F.struct(*old.columns).alias("_o")), new.select(F.col(key).alias("_nk"), F.struct(*new.columns).alias("_n"))
    j = o.join(n, F.col("_ok") == F.col("_nk"), "full_outer")
    pick = lambda c: (F.coalesce(F.col(f"_o.{c}"), F.col(f"_n.{c}")) if c in keep else F.coalesce(F.col(f"_n.{c}"), F.col(f"_o.{c}"))) if c in new.columns else F.col(f"_o.{c}")
    return j.select(*(pick(c).alias(c) for c in old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and those rows of new whose key it lacks, one for each key."""
    fresh = new.join(old.select(key).distinct(), key, "left_anti").dropDuplicates([key])
    return old.unionByName(fresh, allowMissingColumns=True)


def merge_info(rows: DataFrame, patch: DataFrame, key: str, info: str = "info") -> DataFrame:
    """rows with the patch's map laid over their own (the patch wins), and changed: whether that changed anything."""
    p = patch.select(key, F.col(info).alias("_p"))
    j = rows.join(p, key, "left")
    old = F.coalesce(F.col(info), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(F.coalesce("_p", F.create_map().cast("map<string,string>")), k))
    merged = F.when(F.col("_p").isNull(), F.col(info)).otherwise(F.map_concat(kept, "_p"))
    same = F.array_sort(F.map_entries(old)) == F.array_sort(F.map_entries(F.coalesce(merged, F.create_map().cast("map<string,string>"))))
    return j.withColumn("changed", ~same).withColumn(info, merged).drop("_p")


#: Shared marks of an account up to which its peers are counted by inclusion and exclusion.
FEW_MARKS = 6


def shared_peers(marks: DataFrame, who: str = "who", few: int = FEW_MARKS) -> DataFrame:
    """(who, peers): how many other accounts share any mark with an account.

    The accounts that share some of a few marks are counted by inclusion and exclusion: those
    that have each of the marks, less those that have two, and so on. A set of marks is counted
    once, whoever asks, so a mark that millions have costs its rows and never pairs. Accounts with more
    than ``few`` shared marks are joined to the members of these, row by row.
    """
    held = marks.select("kind", "value", who).distinct()
    shared = held.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # marks by number, not by a hash that two could have in common
    named = cut(shared.select("kind", "value", F.monotonically_increasing_id().alias("_k")))
    own = cut(held.join(named, ["kind", "value"]).select(who, "_k"))
    sets = cut(own.groupBy(who).agg(F.array_sort(F.collect_list("_k")).alias("_a")))
    small = sets.filter(F.size("_a") <= few)
    subsets = F.expr("transform(sequence(1, shiftleft(1, size(_a)) - 1), m -> filter(_a, (x, i) -> (shiftright(m, i) & 1) = 1))")
    asked = cut(small.select(who, F.explode(subsets).alias("_s")))
    counted = asked.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    # accounts with many marks have such sets, too
    many = own.join(sets.filter(F.size("_a") > few), who)
    beside = counted.select("_s", F.get("_s", F.lit(0)).alias("_k")).join(many, "_k").filter(F.size(F.array_except("_s", "_a")) == 0).groupBy("_s").agg(F.count(F.lit(1)).alias("_more"))
    total = counted.join(beside, "_s", "left").select("_s", (F.col("_n") + F.coalesce("_more", F.lit(0))).alias("_n"))
    signed = F.when(F.size("_s") % 2 == 1, F.col("_n")).otherwise(-F.col("_n"))
    exact = asked.join(total, "_s").groupBy(who).agg((F.sum(signed) - 1).alias("peers"))
    pairs = many.select(who, "_k").join(own.select("_k", F.col(who).alias("_peer")), "_k").filter(F.col("_peer") != F.col(who)).select(who, "_peer").distinct()
    return exact.unionByName(pairs.groupBy(who).agg(F.count(F.lit(1)).alias("peers")))


def vote_share(votes: DataFrame, menu: list[str], uid: str = "item") -> DataFrame:
    """(uid, label, share): of the votes that were offered a label, how many chose it. votes(uid, labels, menu)."""
    rows = votes.select(uid, "labels", F.explode(F.array_intersect("menu", F.array(*map(F.lit, menu)))).alias("label"))
    return rows.groupBy(uid, "label").agg(F.avg(F.array_contains("labels", F.col("label")).cast("int")).alias("share"))


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, n): rows for which a check doesn't hold; null counts as holding, as constraints have it."""
    bad = F.array_compact(F.array(*(F.when(~c, F.lit(n)) for n, c in checks.items())))
    return rows.select(F.explode(bad).alias("check")).groupBy("check").agg(F.count(F.lit(1)).alias("n"))


def clean_spans(spans: Column, seconds: Column, labels: list[str], most: int = 6, slack: int = 250, shortest: int = 20) -> Column:
    """Spans array<struct<label,start_ms,end_ms,lane>> with ends clamped to the clip if all hold the rules, else null."""
    end = (seconds * 1000).cast("int")
    ok = F.forall(
        spans,
        lambda x: x["label"].isin(*labels) & (x["start_ms"] >= 0) & (x["end_ms"] <= end + slack) & (x["end_ms"] - x["start_ms"] >= shortest) & (x["lane"] >= 0) & (x["lane"] <= 5),
    )
    lanes = F.transform(spans, lambda x: x["lane"])
    alone = F.size(F.array_distinct(lanes)) == F.size(lanes)
    clamped = F.transform(spans, lambda x: F.struct(x["label"].alias("label"), x["start_ms"].alias("start_ms"), F.least(x["end_ms"], end).alias("end_ms"), x["lane"].alias("lane")))
    return F.when(ok & alone & (F.size(spans) <= most), clamped)
