"""Screens and filters over titles, transcripts, probabilities and manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions.columns import max_run, title_words
from quillon.sources.shared import cut


def title_screen(rows: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """Adds blocked_title: the pattern occurs in the words of the path's last part."""
    return rows.withColumn("blocked_title", F.coalesce(title_words(F.col(path)).rlike(pattern), F.lit(False)))


def term_counts(rows: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """(screen, term, n, rows): how often each matched term occurs, by screen."""
    low = F.lower(F.col(text))
    named = lambda screen: lambda t: F.struct(F.lit(screen).alias("screen"), t.alias("term"))
    parts = F.flatten(F.array(*(F.transform(F.regexp_extract_all(low, F.lit(p), F.lit(0)), named(s)) for s, p in patterns.items())))
    hits = rows.select(F.explode(parts).alias("h"))
    return hits.groupBy("h.screen", "h.term").agg(F.count(F.lit(1)).alias("n"))


def transcript_screen(rows: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """Adds hits (map of counts by screen) and blocked: any hit."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    counts = {s: F.regexp_count(low, F.lit(p)) for s, p in patterns.items()}
    out = rows.withColumn("hits", F.create_map(*[x for s, c in counts.items() for x in (F.lit(s), c)]))
    return out.withColumn("blocked", F.exists(F.map_values("hits"), lambda n: n > 0))


def first_reason(rows: DataFrame, reasons: list[tuple[str, Column]], name: str = "reason") -> DataFrame:
    """Adds the first reason whose condition holds; null if none does."""
    out = F.lit(None).cast("string")
    for reason, condition in reversed(reasons):
        out = F.when(F.coalesce(condition, F.lit(False)), reason).otherwise(out)
    return rows.withColumn(name, out)


def reason_counts(rows: DataFrame, name: str = "reason") -> DataFrame:
    return rows.groupBy(F.coalesce(name, F.lit("kept")).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def uncertain_band(probs: Column, low: float, high: float) -> Column:
    """Whether any class lies within the band."""
    return F.exists(F.map_values(probs), lambda p: (p >= low) & (p <= high))


def decided(probs: Column, negative: float, positive: float) -> Column:
    """Whether every class is clearly no or clearly yes."""
    return F.forall(F.map_values(probs), lambda p: (p <= negative) | (p >= positive))


def training_rows(fused: DataFrame, positive: float = 0.6, negative: float = 0.2, least: float = 1.0, background: str = "background") -> DataFrame:
    """fused(uid, probs) -> (uid, label, w): a row per likely class weighted by its probability, one background row where
    all are unlikely, none in between; classes of too little weight go."""
    likely = F.map_entries(F.map_filter("probs", lambda k, v: v >= positive))
    rows = F.when(F.size(likely) > 0, F.transform(likely, lambda e: F.struct(e["key"].alias("label"), e["value"].alias("w")))).when(
        F.forall(F.map_values("probs"), lambda p: p < negative), F.array(F.struct(F.lit(background).alias("label"), F.lit(1.0).alias("w")))
    )
    flat = fused.select("uid", F.explode(rows).alias("r")).select("uid", "r.label", "r.w")
    enough = flat.groupBy("label").agg(F.sum("w").alias("s")).filter(F.col("s") >= least).select("label")
    return flat.join(enough, "label", "left_semi").select("uid", "label", "w")


def cell_precision(judged: DataFrame, rows: DataFrame, least: float = 0.4, floor: int = 1, thin: float = 0.0) -> DataFrame:
    """rows(uid, source, label) weighted by the measured precision of their (source, label) cell; poor and unjudged cells go.

    Then classes whose weights add up to less than ``thin`` go.
    """
    cells = judged.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("pred") == F.col("label")).cast("int")).alias("w"))
    good = cells.filter((F.col("w") >= least) & (F.col("n") >= floor)).select("source", "label", "w")
    weighed = rows.join(good, ["source", "label"])
    if thin <= 0:
        return weighed
    enough = weighed.groupBy("label").agg(F.sum("w").alias("_s")).filter(F.col("_s") >= thin).select("label")
    return weighed.join(enough, "label", "left_semi")


#: Seconds that a chapter must have.
CHAPTER = 60.0


def candidate_checks(rows: DataFrame, known: DataFrame | None = None, per_channel: int = 20, order: str = "n") -> DataFrame:
    """rows(n: their order, id, cls, channel, kind, chapters array<struct<start, end>>) with short chapters left out, and reason: null if taken.

    Reasons, the first that holds: `schema` (a field is missing, or the identifier isn't eleven
    word characters), `kind`, `no chapters`, `dup` (known, or not the first valid row of its identifier),
    `channel cap` (beyond ``per_channel`` of a class and channel, in order).
    """
    long = F.filter(F.coalesce("chapters", F.array().cast(rows.schema["chapters"].dataType)), lambda c: F.coalesce(c["end"] - c["start"] >= CHAPTER, F.lit(False)))
    cut_down = rows.withColumn("chapters", F.when(F.col("kind") == "chapter", long).otherwise(F.col("chapters")))
    schema = F.col("id").isNull() | F.col("cls").isNull() | F.col("kind").isNull() | ~F.col("id").rlike(r"\A[\w-]{11}\z")
    checked = first_reason(cut_down, [("schema", schema), ("kind", ~F.col("kind").isin("single", "chapter")), ("no chapters", (F.col("kind") == "chapter") & (F.size("chapters") == 0))])
    valid = F.col("reason").isNull()
    if known is not None:
        checked = checked.join(known.select("id").distinct().withColumn("_known", F.lit(True)), "id", "left")
    else:
        checked = checked.withColumn("_known", F.lit(None).cast("boolean"))
    turn = F.row_number().over(W.partitionBy("id", valid).orderBy(order))
    checked = checked.withColumn("reason", F.when(valid & (F.coalesce("_known", F.lit(False)) | (turn > 1)), "dup").otherwise(F.col("reason"))).drop("_known")
    place = F.row_number().over(W.partitionBy("cls", "channel", F.col("reason").isNull()).orderBy(order))
    return checked.withColumn("reason", F.when(F.col("reason").isNull() & (place > per_channel), "channel cap").otherwise(F.col("reason")))


def looped(rows: DataFrame, most: int = 3, text: str = "text") -> DataFrame:
    """Rows in which no word stands more than ``most`` times in a row."""
    return rows.filter(F.coalesce(max_run(F.col(text)), F.lit(0)) <= most)


def speech_gate(spans: DataFrame, least_share: float = 0.05, least_seconds: float = 20.0, source: str = "source") -> DataFrame:
    """Sources with enough speech: (source, speech, total, passed) from spans(source, start, end, kind)."""
    d = F.col("end") - F.col("start")
    g = spans.groupBy(source).agg(F.sum(F.when(F.col("kind") == "speech", d).otherwise(0.0)).alias("speech"), F.sum(d).alias("total"))
    return g.withColumn("passed", (F.col("speech") >= least_seconds) & (F.col("speech") >= least_share * F.col("total")))


def licence_filter(rows: DataFrame, licence: str = "licence", evals: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Rows without non-commercial or sampling licences and not in the evaluation set."""
    free = rows.filter(~F.coalesce(F.lower(licence).rlike(r"by-nc|sampling\+"), F.lit(False)))
    return free.join(evals.select(key).distinct(), key, "left_anti") if evals is not None else free


#: Items (rows of a few words' keys) that may be broadcast; with more, keys are shuffled and texts joined to the candidates.
BROADCAST_ROWS = 200_000
#: Items of fewer than three words that are tried on every text as they are; with more, they have keys of characters.
SHORT_ITEMS = 1_000
#: Characters of a short item's key.
KEY = 3


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_text: str = "text", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS, short_items: int = SHORT_ITEMS) -> DataFrame:
    """Documents that hold a benchmark text in full, line breaks included: (doc_id, item_id), each pair once.

    An item of three words or more has the rarest of its inner words as anchor (all but the
    first and last, which may be cut out of longer words of a document): that of fewest
    documents. Documents' words are joined to the anchors, and the whole texts of those that
    hold one are compared. Shorter items are compared with every text, or, if there are many,
    with those that hold their first characters. Null texts hold nothing and are held by
    nothing; an empty item is in every text that isn't null.
    """
    words = lambda t: F.array_remove(F.split(t, r"\s+"), "")
    own = docs.select("doc_id", F.col(doc_text).alias("_text")).filter("_text IS NOT NULL")
    items = cut(benchmark.select("item_id", F.col(item_text).alias("_item")).filter("_item IS NOT NULL").withColumn("_n", F.size(words(F.col("_item")))))
    n = {r.short: r.n for r in items.groupBy((F.col("_n") < 3).alias("short")).agg(F.count(F.lit(1)).alias("n")).collect()}
    held = F.contains("_text", "_item")
    found = []

    def by_key(keys, keyed: DataFrame, small: bool) -> None:
        """Pairs by the keys of a text (an array) and the items' ``_key``."""
        if small:  # texts stay where they are
            found.append(own.select("doc_id", "_text", F.explode(keys).alias("_key")).join(F.broadcast(keyed), "_key").filter(held).select("doc_id", "item_id"))
            return
        pairs = cut(own.select("doc_id", F.explode(keys).alias("_key")).join(keyed.select("_key", "item_id"), "_key").select("doc_id", "item_id").distinct())
        texts = own.alias("d").join(pairs.alias("p"), F.expr("d.doc_id <=> p.doc_id")).select("p.doc_id", "p.item_id", "_text")
        found.append(texts.join(items, "item_id").filter(held).select("doc_id", "item_id"))

    if n.get(False):
        long = items.filter("_n >= 3")
        inner = F.array_distinct(F.slice(words(F.col("_item")), 2, F.col("_n") - 2))
        each = cut(long.select("item_id", "_item", F.explode(inner).alias("_key")))
        vocabulary = each.select("_key").distinct()
        small = each.count() <= broadcast_rows
        of_text = F.array_distinct(words(F.col("_text")))
        spread = own.select(F.explode(of_text).alias("_key")).join(F.broadcast(vocabulary) if small else vocabulary, "_key").groupBy("_key").agg(F.count(F.lit(1)).alias("_in"))
        rarest = each.join(spread, "_key", "left").groupBy("item_id", "_item").agg(F.min(F.struct(F.coalesce("_in", F.lit(0)).alias("_in"), "_key")).alias("_a"))
        # an anchor in no document: nor is the item
        by_key(of_text, cut(rarest.filter("_a._in > 0").select("item_id", "_item", F.col("_a._key").alias("_key"))), small)
    if n.get(True):
        short = items.filter("_n < 3").select("item_id", "_item")
        if n[True] <= short_items:
            found.append(own.join(F.broadcast(short), held).select("doc_id", "item_id"))
        else:
            keyed = short.withColumn("_key", F.substring("_item", 1, KEY))
            pieces = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_text") - k + 1)), lambda i: F.substring(F.col("_text"), i, F.lit(k)))
            by_key(F.array_distinct(F.concat(F.array(F.lit("")), *(pieces(k) for k in range(1, KEY + 1)))), keyed, n[True] <= broadcast_rows)
    if not found:
        return docs.select("doc_id").join(items.select("item_id"), F.lit(False))
    return reduce(DataFrame.unionByName, found).distinct()
