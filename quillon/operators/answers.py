"""Answers of models and people: extraction, filters, updates and orders of the labelling site."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.operators.order import running

from quillon.functions.columns import normalise_labels

#: Status of a labeller, worst first.
STATUSES = ("weak", "watch", "too early", "ok")


def answer_labels(text, menu: Sequence[str], synonyms: dict[str, str] | None = None) -> Column:
    """Labels of a model's free answer: of the text from its first to its last brace, read as JSON, the list ``labels``.

    Answers without braces, with broken JSON or with anything but a list give an empty list.
    """
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return normalise_labels(F.from_json(found, "labels array<string>")["labels"], synonyms or {}, menu)


def usable(rows: DataFrame, uid: str = "uid", raw: str = "raw", skipped: str = "skipped") -> DataFrame:
    """Rows that are answers: not those with an error for an answer, skipped ones, or those without an identifier."""
    error = F.coalesce(F.col(raw).startswith("ERROR"), F.lit(False))
    return rows.filter(~error & ~F.coalesce(F.col(skipped), F.lit(False)) & (F.coalesce(F.col(uid), F.lit("")) != ""))


def after_intro(rows: DataFrame, seconds: float = 30.0, start: str = "start") -> DataFrame:
    """Rows that don't start in the intro; a missing start is the beginning."""
    return rows.filter(F.coalesce(F.col(start), F.lit(0.0)) >= seconds)


def judges_agree(rows: DataFrame, fused: DataFrame, title_map: dict[str, str], agree: float = 0.5, uid: str = "uid", label: str = "label") -> DataFrame:
    """rows with why: ``tier 3`` where the fused probability of the title's class is enough, else what is amiss. fused(uid, probs map)."""
    names = F.create_map(*[F.lit(x) for kv in title_map.items() for x in kv]) if title_map else None
    cls = F.coalesce(F.try_element_at(names, F.col(label)), F.col(label)) if title_map else F.col(label)
    p = F.try_element_at("_probs", cls)
    why = F.when(p.isNull(), "not fused or off the menu").when(p < agree, "judges disagree with the name").otherwise("tier 3")
    return rows.join(fused.select(uid, F.col("probs").alias("_probs")), uid, "left").withColumns({"title_class": cls, "why": why}).drop("_probs")


def majority_labels(people) -> Column:
    """Labels that at least half of the people of a JSON map {who: [labels]} gave, sorted; null unless it is a map."""
    m = F.from_json(people, "map<string,array<string>>")
    every = F.flatten(F.transform(F.map_values(m), lambda v: F.coalesce(v, F.array().cast("array<string>"))))
    most = F.filter(F.array_distinct(every), lambda x: 2 * F.size(F.filter(every, lambda y: y == x)) >= F.size(m))
    return F.when(F.ltrim(people).startswith("{") & m.isNotNull(), F.array_sort(most))


def span_labels(spans, other) -> Column:
    """Distinct labels of spans (array of structs with ``label``), sorted, and ``something else`` if the free text isn't blank."""
    more = F.when(F.trim(F.coalesce(other, F.lit(""))) != "", F.array(F.lit("something else"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(F.transform(spans, lambda s: s["label"]), F.array().cast("array<string>")), more)))


def class_boost(title_class, unsure, title_tags, new: Sequence[str], thin: Sequence[str], same: dict[str, str] | None = None, for_new: float = 0.5, for_thin: float = 0.3) -> Column:
    """Serving boost of a clip: for a tag among the new labels, else for a thin class by title, unsure list or tag, else 0."""
    known = lambda a, names: F.coalesce(F.arrays_overlap(a, F.array(*map(F.lit, names))), F.lit(False)) if names else F.lit(False)
    cls = title_class
    for name, as_ in (same or {}).items():
        cls = F.when(title_class == name, as_).otherwise(cls)
    is_thin = F.coalesce(cls.isin(*thin), F.lit(False)) | known(unsure, thin) | known(title_tags, thin)
    return F.when(known(title_tags, new), F.lit(for_new)).when(is_thin, F.lit(for_thin)).otherwise(F.lit(0.0))


def members(pairs: DataFrame, clips: DataFrame, a: str = "a", b: str = "b", key: str = "id") -> DataFrame:
    """Pairs joined to their two members: the pair's columns, and those of the clip as member struct; one equi-join."""
    one = pairs.withColumn("_m", F.explode(F.array_distinct(F.array_compact(F.array(a, b)))))
    held = clips.select(F.col(key).alias("_m"), F.struct(*clips.columns).alias("member"))
    return one.join(held, "_m").drop("_m")


def update_from_records(rows: DataFrame, patches: DataFrame, key: str, value: str, kind: str, records: str = "records", order: str = "seq") -> DataFrame:
    """rows with ``value`` from JSON lists of records [{key, value}], and changed: whether it differs from what stood there (null counts).

    Of several records of one key the last counts: by the patch's order, then by place in its list.
    """
    schema = f"array<struct<`{key}`:{rows.schema[key].dataType.simpleString()},`{value}`:{kind}>>"
    listed = patches.select(F.col(order).alias("_seq"), F.posexplode(F.from_json(records, schema)).alias("_at", "_r")).filter(F.col(f"_r.{key}").isNotNull())
    last = listed.groupBy(F.col(f"_r.{key}").alias(key)).agg(F.max_by(F.struct(F.col(f"_r.{value}").alias("v")), F.struct("_seq", "_at")).alias("_n"))
    j = rows.join(last, key, "left")
    changed = F.col("_n").isNotNull() & ~F.col("_n.v").eqNullSafe(F.col(value))
    return j.withColumn("changed", changed).withColumn(value, F.when(F.col("_n").isNotNull(), F.col("_n.v")).otherwise(F.col(value))).drop("_n")


def tied_ranks(rows: DataFrame, by: str, name: str = "rank") -> DataFrame:
    """rows with rank() by a value, largest first, ties sharing a rank and leaving gaps; null has none.

    Distinct values are numbered by ranges with running counts, so no task sorts them all.
    """
    counts = rows.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counts, [F.col(by).desc()], sums={"_upto": F.col("_n")}).select(by, (F.col("_upto") - F.col("_n") + 1).alias(name))
    return rows.join(ranked, by, "left")


def worst_first(rows: DataFrame, status: str = "status", follow: str = "follow", answers: str = "answers") -> DataFrame:
    """Labellers by status as listed, then by agreement with nulls first, then by number of answers."""
    return rows.orderBy(F.array_position(F.array(*map(F.lit, STATUSES)), F.col(status)), F.col(follow).asc_nulls_first(), F.col(answers).desc())


def unanimous(votes: DataFrame, judges: int, uid: str = "uid", judge: str = "judge", vote: str = "vote") -> DataFrame:
    """(uid, votes map of counts, unanimous) of the clips that all judges have judged; a judge's last vote in order counts once."""
    each = votes.groupBy(uid, judge).agg(F.max(vote).alias(vote))
    tally = each.groupBy(uid, vote).agg(F.count(F.lit(1)).alias("n"))
    clips = tally.groupBy(uid).agg(F.sum("n").alias("_all"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(vote, "n")))).alias("votes"))
    return clips.filter(F.col("_all") == judges).select(uid, "votes", (F.size("votes") == 1).alias("unanimous"))


def caption(modifier, key) -> Column:
    """The caption of a cut-out sound."""
    return F.format_string("ASMR %s %s, close-mic binaural, no speech", modifier, key)


def caption_tag(modifier, key) -> Column:
    return F.format_string("[%s][%s]", modifier, key)


def voice_route(category, title, first: str, second: str) -> Column:
    """Where a post goes by its voice tag: F4.., M4.. or FM4.. in the title, else the category's first letter; null if neither tells."""
    letter = F.regexp_extract(F.upper(F.coalesce(title, F.lit(""))), r"\b([FM])[FM]?4", 1)
    initial = F.upper(F.regexp_extract(F.lower(F.coalesce(category, F.lit(""))), r"^([fm])", 1))
    voice = F.when(letter != "", letter).when(initial != "", initial)
    return F.when(voice == "F", first).when(voice == "M", second)


def acquisition_plan(posts: DataFrame, patterns: dict[str, tuple[str, float]], first: str, second: str, least_matches: int = 3, least_seen: int = 5, most_files: int = 60) -> DataFrame:
    """posts(uploader, title, tags array, category, minutes) -> one row per uploader worth fetching: hits of each deficit pattern
    (regular expression, weight), route, files to take, score. Uploaders with too few matches or posts, or mostly without a route, go."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), "tags"))
    hits = {f"hits_{n}": F.sum(F.when(text.rlike(p), 1).otherwise(0)) for n, (p, _) in patterns.items()}
    route = F.coalesce(voice_route(F.col("category"), F.col("title"), first, second), F.lit("?"))
    routed = posts.withColumn("_route", route)
    votes = routed.groupBy("uploader", "_route").agg(F.count(F.lit(1)).alias("_n")).groupBy("uploader").agg(F.max_by("_route", F.struct("_n", "_route")).alias("route"))
    seen = routed.groupBy("uploader").agg(F.count(F.lit(1)).alias("posts_seen"), F.sum(F.coalesce("minutes", F.lit(0))).alias("minutes_seen"), *(h.alias(n) for n, h in hits.items()))
    matched = sum((F.col(n) for n in hits), F.lit(0))
    score = sum((F.col(f"hits_{n}") * F.lit(w) for n, (_, w) in patterns.items()), F.lit(0.0))
    plan = seen.join(votes, "uploader").withColumns({"matched": matched, "take_files": F.least("posts_seen", F.lit(most_files)), "score": score})
    return plan.filter((F.col("matched") >= least_matches) & (F.col("posts_seen") >= least_seen) & (F.col("route") != "?"))


def recent(rows: DataFrame, at: str, now, days: int) -> DataFrame:
    """Rows later than so many days before now."""
    return rows.filter(F.col(at) > now - F.make_interval(days=F.lit(days)))


def prior_of(rows: DataFrame, wanted: DataFrame, weights: dict[str, float], source: str = "source", label: str = "label") -> DataFrame:
    """wanted(source) with prior: mean label weight of its rows; the mean over all rows for sources that have none."""
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col(label)), F.lit(0.0))
    own = rows.groupBy(source).agg(F.avg(w).alias("prior"))
    mean = rows.agg(F.avg(w).alias("_mean"))  # one row
    return wanted.join(own, source, "left").join(F.broadcast(mean)).withColumn("prior", F.coalesce("prior", "_mean")).drop("_mean")


def bytes_stored(objects: DataFrame, metadata: str = "metadata") -> DataFrame:
    """(objects, bytes): the sum of the sizes that the objects' JSON metadata state."""
    return objects.agg(F.count(F.lit(1)).alias("objects"), F.sum(F.get_json_object(metadata, "$.size").try_cast("bigint")).alias("bytes"))
