"""Which clips' audio is kept on the site: what goes to make room, what comes back, what is added, under a byte budget.

All three take rows from the head of an order until a budget of bytes is met. Running
sums of bytes go by ranges, so that no task holds the table and nothing is drawn page by page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.order import running


def make_room(clips: DataFrame, open_leases: DataFrame, goal: float, batch: str, size: str = "bytes") -> DataFrame:
    """(item, bytes, freed): unheard active clips of a batch, least needed first, that nobody holds open, until so many bytes are free.

    clips(item, active, votes, batch, need, bytes). Nothing goes for a goal of 0 or less; if
    there aren't enough clips, all go.
    """
    unheard = clips.filter(F.col("active") & (F.col("votes") == 0) & (F.col("batch") == batch)).join(open_leases.select("item").distinct(), "item", "left_anti")
    rows = running(unheard.select("item", "need", F.coalesce(size, F.lit(0)).cast("long").alias("bytes")), ["need", "item"], sums={"freed": F.col("bytes")})
    return rows.filter(F.col("freed") - F.col("bytes") < F.lit(goal)).select("item", "bytes", "freed")


def reload_order(clips: DataFrame) -> DataFrame:
    """Clips taken down that people still need: (item, place), started ones first, then by need."""
    wanted = clips.filter(~F.col("active") & ~F.col("blocked") & (F.col("votes") < F.col("target")) & (F.col("kind") != "confident"))
    return running(wanted.select("item", "votes", "need"), [F.col("votes").cast("int").isin(0), F.col("need").desc(), "item"]).select("item", "place")


def until_full(candidates: DataFrame, files: DataFrame, room: float) -> DataFrame:
    """(item, place, bytes, action): candidates(item, place) from the first on, until the first whose file doesn't fit in the room left.

    Those without a file (files(item, bytes)) take none and are passed over: action `missing`
    instead of `take`. Where there is no room at all nothing is looked at.
    """
    sized = candidates.join(files.select("item", F.col("bytes").cast("long").alias("bytes")), "item", "left")
    rows = running(sized, ["place"], sums={"_sum": F.coalesce("bytes", F.lit(0))})
    out = rows.filter((F.col("_sum") <= F.lit(room)) & F.lit(room > 0))
    return out.select("item", "place", "bytes", F.when(F.col("bytes").isNull(), "missing").otherwise("take").alias("action"))


def working_set(clips: DataFrame, open_leases: DataFrame, files: DataFrame, budget: float, used: float, goal: float = 0.0, batch: str | None = None, new: DataFrame | None = None) -> DataFrame:
    """(item, action, bytes): `down` makes room, then `back` reloads and `new` fills what room the budget has left; `missing` ones lack a file.

    ``new`` (item, place) are clips to add, in order, of which those that are known as
    clips are left out. What one step takes is gone for the next.
    """
    down = make_room(clips, open_leases, goal, batch) if batch and goal > 0 else None
    freed = (down.agg(F.sum("bytes")).first()[0] or 0) if down is not None else 0
    room = budget - used + freed
    named = lambda df, take: df.select("item", F.when(F.col("action") == "take", take).otherwise(F.col("action")).alias("action"), "bytes")
    back = until_full(reload_order(clips), files, room)
    out = named(back, "back")
    if new is not None:
        room -= back.filter("action = 'take'").agg(F.sum("bytes")).first()[0] or 0
        out = out.unionByName(named(until_full(new.join(clips.select("item"), "item", "left_anti"), files, room), "new"))
    return out if down is None else down.select("item", F.lit("down").alias("action"), "bytes").unionByName(out)
