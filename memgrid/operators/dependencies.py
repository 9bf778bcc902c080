"""States of changes that depend on each other, along chains of any length and around circles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import saved
from .skew import looked_up

#: Parts of the visited set that are put together before they are joined on.
PARTS = 12
#: Times that loose ends are taken off before the edges are written.
STEPS = 3


def led_to(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(event_id) of the seeds and of all events that lead to one over edges (event_id, need). A round joins the events that the last one added."""
    front = saved(seeds.select("event_id").distinct())
    parts = [front]
    while not front.isEmpty():
        new = edges.join(front.withColumnRenamed("event_id", "need"), "need", "left_semi").select("event_id").distinct()
        for part in parts:
            new = new.join(part, "event_id", "left_anti")
        front = saved(new)
        parts.append(front)
        if len(parts) > PARTS:
            parts = [saved(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts)


def jumps(edges: DataFrame) -> list[DataFrame]:
    """(event_id, end) of the events that need one other alone, one, two, four, ... of them on; where the way leaves such events it stays.

    As many tables as the number of these events has bits: a chain of n is at its end after log2(n) rounds.
    """
    one = edges.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("end")).where("n = 1").select("event_id", "end")
    out = [saved(one)]
    left, span = out[0].count(), 1
    while span < left:
        last = out[-1]
        out.append(saved(looked_up(last, last.select(F.col("event_id").alias("end"), F.col("end").alias("next")), "end").select("event_id", F.coalesce("next", "end").alias("end"))))
        if out[-1].join(last, ["event_id", "end"], "left_anti").isEmpty():
            break
        span *= 2
    return out


def circles(edges: DataFrame) -> DataFrame:
    """(event_id, circle) of the events of edges (event_id, need) that lead to themselves; those that lead to each other share a number.

    Events without a way on, or without a way in, are taken off as long as there are any; then each takes the least number that leads to
    it, and the events that lead back to the one of that number, within it, are a circle; what is left goes on. Rounds are as many as the
    longest way has edges; edges only get fewer.
    """
    found = saved(edges.select("event_id", F.col("event_id").alias("circle")).limit(0))
    edges, size = saved(edges.select("event_id", "need").distinct()), -1
    while not edges.isEmpty():
        while size != (size := edges.count()) and size:
            for _ in range(STEPS):
                edges = edges.join(edges.select(F.col("event_id").alias("need")).distinct(), "need", "left_semi").select("event_id", "need")
                edges = edges.join(edges.select(F.col("need").alias("event_id")).distinct(), "event_id", "left_semi").select("event_id", "need")
            edges = saved(edges)
        if not size:
            break
        colour, moved = saved(edges.select("event_id").distinct().withColumn("circle", F.col("event_id"))), True
        while moved:
            said = edges.join(colour, "event_id").groupBy(F.col("need").alias("event_id")).agg(F.min("circle").alias("said"))
            new = saved(colour.join(said, "event_id", "left").select("event_id", F.least("circle", "said").alias("circle"), F.coalesce(F.col("said") < F.col("circle"), F.lit(False)).alias("moved")))
            moved, colour = not new.where("moved").isEmpty(), new.drop("moved")
        within = edges.join(colour, "event_id").join(colour.select(F.col("event_id").alias("need"), F.col("circle").alias("other")), "need").where("circle = other")
        back = saved(led_to(within.select("event_id", "need"), colour.where("event_id = circle")).join(colour, "event_id"))
        # one that is alone leads to itself only by an edge of its own
        many = back.groupBy("circle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("circle")
        alone = edges.where("event_id = need").select("event_id")
        ring = back.join(many, "circle", "left_semi").select("event_id", "circle").unionByName(back.join(alone, "event_id", "left_semi").select("event_id", "circle")).distinct()
        found = saved(found.unionByName(ring))
        gone = back.select("event_id")
        edges, size = saved(edges.join(gone, "event_id", "left_anti").join(gone.withColumnRenamed("event_id", "need"), "need", "left_anti").select("event_id", "need")), -1
    return found


def settled(changes: DataFrame) -> DataFrame:
    """(event_id, state) of changes (event_id, depends_on, retry_count, max_retries, failed).

    Failed ones are `retry` while they have retries left, else `dead`. Of the others, those from which a dead one is reached over what
    they need, are `blocked`; those that need themselves in the end are a `circle`; those that reach one to be tried again, a circle or
    one that isn't there are `waiting`; the rest is `done`. Ways end at failed ones. A null list is an empty one, and repeated needs count once.

    Chains of events with one need each are jumped over; what is left is walked from its ends, an edge a round.
    """
    own = F.when(F.col("failed"), F.when(F.col("retry_count") < F.col("max_retries"), "retry").otherwise("dead")).otherwise("done")
    needs = F.array_distinct(F.coalesce("depends_on", F.array().cast(changes.schema["depends_on"].dataType)))
    rows = saved(changes.select("event_id", needs.alias("needs"), own.alias("own")))
    states = rows.select(F.col("event_id").alias("need"), F.col("own").alias("at"))
    edges = saved(looked_up(rows.where("own = 'done'").select("event_id", F.explode("needs").alias("need")), states, "need"))
    ways = jumps(edges.select("event_id", "need"))
    # `stands`: where a need's chain ends; a chain that stays among single needs goes round
    last = ways[-1]
    ends = saved(looked_up(last, last.select(F.col("event_id").alias("end"), F.lit(True).alias("round")), "end").select("event_id", "end", F.coalesce("round", F.lit(False)).alias("round")))
    ends = saved(looked_up(ends.withColumnRenamed("end", "need"), states, "need").withColumnRenamed("need", "end"))
    rest = edges.join(ends.select("event_id"), "event_id", "left_anti")
    rest = looked_up(rest, ends.select(F.col("event_id").alias("need"), "end", "round", F.col("at").alias("end_at")), "need")
    rest = saved(rest.select("event_id", "need", F.coalesce("end", "need").alias("end"), F.coalesce("round", F.lit(False)).alias("round"), F.when(F.col("end").isNull(), F.col("at")).otherwise(F.col("end_at")).alias("at")))
    short = saved(rest.select("event_id", F.col("end").alias("need"), "round", "at").distinct())
    blocked = saved(led_to(short.select("event_id", "need"), short.where("at = 'dead' and not round")))
    free = saved(short.join(blocked, "event_id", "left_anti"))
    ring = saved(circles(free.where("not round and at = 'done'").select("event_id", "need")))
    stops = free.where("round or at is null or at = 'retry'").select("event_id").unionByName(ring.select("event_id"))
    waiting = saved(led_to(free.select("event_id", "need"), stops))
    told = blocked.withColumn("state", F.lit("blocked")).unionByName(waiting.join(blocked, "event_id", "left_anti").withColumn("state", F.lit("waiting")))
    told = saved(told)
    # events on chains share the fate of their end
    chain = looked_up(ends, told.select(F.col("event_id").alias("end"), "state"), "end")
    fate = F.when(F.col("round") | F.col("at").isNull() | (F.col("at") == "retry"), "waiting").when(F.col("at") == "dead", "blocked").otherwise(F.col("state"))
    told = told.unionByName(chain.select("event_id", fate.alias("state")).where("state is not null"))
    # circles: of single needs, where the jumps end; and the chains between two events of a circle
    around = ends.where("round").select(F.col("end").alias("event_id")).distinct()
    inside = rest.join(ring, "event_id").join(ring.select(F.col("event_id").alias("end"), F.col("circle").alias("other")), "end").where("circle = other and need <> end")
    marked = saved(inside.select(F.col("need").alias("event_id")).distinct())
    if not marked.isEmpty():
        for way in reversed(ways):
            marked = saved(marked.unionByName(way.join(marked, "event_id", "left_semi").select(F.col("end").alias("event_id"))).distinct())
    on = around.unionByName(ring.select("event_id")).unionByName(marked).distinct().withColumn("on", F.lit(True))
    out = rows.select("event_id", "own").join(told, "event_id", "left").join(on, "event_id", "left")
    state = F.when(F.col("own") != "done", F.col("own")).when(F.col("state") == "blocked", "blocked").when(F.col("on"), "circle").otherwise(F.coalesce("state", F.lit("done")))
    return out.select("event_id", state.alias("state"))
