"""Writes and reads of the memory tables, as algebra over existing and incoming rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stage import saved

#: Ranges that a group's values are cut into for ranks, a power of two.
RANGES = 256


def first_of(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upserted(existing: DataFrame, incoming: DataFrame, key: str, policy: str = "ignore") -> DataFrame:
    """The table after a write. ignore keeps old rows, replace takes new ones, update fills a new row's nulls from the old, error forbids clashes."""
    if policy == "update":
        old, new = existing.select(F.struct(*existing.columns).alias("o"), F.col(key).alias("_k")), incoming.select(F.struct(*existing.columns).alias("i"), F.col(key).alias("_k"))
        return old.join(new, "_k", "full").select(*[F.coalesce(F.col(f"i.{c}"), F.col(f"o.{c}")).alias(c) for c in existing.columns])
    if policy == "ignore":
        return existing.unionByName(incoming.join(existing.select(key), key, "left_anti").select(*existing.columns))
    if policy == "replace":
        return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming.select(*existing.columns))
    if policy == "error":
        clash = incoming.join(existing.select(key).withColumn("_old", F.lit(True)), key, "left")
        checked = clash.withColumn(key, F.when(F.col("_old"), F.raise_error(F.concat(F.lit("duplicate key "), F.col(key).cast("string"))).cast("string")).otherwise(F.col(key).cast("string")).cast(incoming.schema[key].dataType))
        return existing.unionByName(checked.select(*existing.columns))
    raise ValueError(policy)


def archived(rows: DataFrame, key: str, value: object, as_of: Column) -> DataFrame:
    hit = F.col(key) == F.lit(value)
    return rows.withColumns({"status": F.when(hit, "archived").otherwise(F.col("status")), "updated_at": F.when(hit, as_of)})


def with_tags(tags: Sequence[str], match_all: bool = False) -> Column:
    """An empty list matches nothing; rows without tags never match."""
    if not tags:
        return F.lit(False)
    wanted = F.array(*map(F.lit, tags))
    return F.coalesce(F.forall(wanted, lambda t: F.array_contains("tags", t)) if match_all else F.arrays_overlap("tags", wanted), F.lit(False))


def conditions(since: float | None = None, tags: Sequence[str] = (), kinds: Sequence[str] = (), active_only: bool = False) -> Column:
    """All given filters at once; none of them means every row."""
    out = F.lit(True)
    if since:
        out = out & (F.col("created_at_unix") >= since)
    if tags:
        out = out & with_tags(tags)
    if kinds:
        out = out & F.col("memory_type").isin(*kinds)
    return out & (F.col("status") == "active") if active_only else out


def recent_turns(messages: DataFrame, turns: int) -> DataFrame:
    newest = W.partitionBy("session_id").orderBy(F.desc("turn_index"))
    return messages.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= turns).drop("n")


def rolling_context(messages: DataFrame, turns: int = 12, budget: int = 400) -> DataFrame:
    """The latest turns of a session, at most so many, and of them the longest end whose tokens fit the budget."""
    rows = recent_turns(messages, turns)
    newest = W.partitionBy("session_id").orderBy(F.desc("turn_index")).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("total", F.sum(F.coalesce("tokens", F.lit(0))).over(newest)).where(F.col("total") <= budget).drop("total")


def candidates(observations: DataFrame, reflections: DataFrame, least: int = 3, latest: int = 100, members: int = 10) -> DataFrame:
    """(session_id, tag, n, members): observations of each session not yet consolidated, grouped by tag."""
    recent = observations.withColumn("n", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("created_at_unix"), "key"))).where(F.col("n") <= latest)
    used = reflections.where("status = 'active'").select(F.explode("consolidates").alias("id")).distinct()
    rows = recent.join(used, "id", "left_anti").select("session_id", "key", "created_at_unix", F.explode("tags").alias("tag"))
    place = W.partitionBy("session_id", "tag").orderBy(F.desc("created_at_unix"), "key")
    rows = rows.withColumns({"n": F.row_number().over(place), "all": F.count(F.lit(1)).over(W.partitionBy("session_id", "tag"))}).where(F.col("all") >= least).where(F.col("n") <= members)
    return rows.groupBy("session_id", "tag", "all").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "key"))), lambda x: x["key"]).alias("members")).withColumnRenamed("all", "n")


def consolidated(found: DataFrame, observations: DataFrame, preview: int = 80) -> DataFrame:
    """(key, session_id, tag, consolidates, source_count, content) for each of the candidates (session_id, tag, n, members): the reflections
    that all sessions' clusters make; content is what the members begin with, in their order. A cluster has few members."""
    rows = found.select("session_id", "tag", "n", F.posexplode("members").alias("pos", "key"))
    rows = rows.join(observations.select("key", "id", F.substring(F.coalesce("content", F.lit("")), 1, preview).alias("head")), "key")
    one = F.array_sort(F.collect_list(F.struct("pos", "id", "head")))
    rows = rows.groupBy("session_id", "tag", "n").agg(one.alias("x"))
    key = F.concat(F.lit("ref_"), F.substring(F.sha2(F.concat_ws("|", "session_id", "tag", F.array_join(F.transform("x", lambda y: y["id"]), ",")), 256), 1, 16))
    return rows.select(key.alias("key"), "session_id", "tag", F.transform("x", lambda y: y["id"]).alias("consolidates"), F.size("x").cast("long").alias("source_count"), F.array_join(F.transform("x", lambda y: y["head"]), "\n").alias("content"))


def reflections(found: DataFrame, observations: DataFrame, as_of: float, generator: Callable[[Column], Column], embedder: Callable[[Column], Column], template: str = "{observations}") -> DataFrame:
    """The whole reflections of candidates (session_id, tag, n, members): (key, session_id, tag, content, tags, consolidates, source_count,
    strength, prompt_tokens, embedding).

    The prompt lists the members in their order, numbered, with type, text and tags; generator makes the content of it, embedder a vector of
    the content. tags are those of all members, sorted; strength is the mean of what 30 days leave of the members' recency, to two digits.
    """
    rows = found.select("session_id", "tag", F.posexplode("members").alias("pos", "key")).join(observations.select("key", "id", "memory_type", "content", "tags", "created_at_unix"), "key")
    own = F.array_compact(F.coalesce("tags", F.array().cast("array<string>")))
    left = F.greatest(F.lit(0.0), 1.0 - (F.lit(as_of) - F.col("created_at_unix")) / F.lit(86400.0 * 30))
    text = F.concat(F.upper("memory_type"), F.lit(": "), F.coalesce("content", F.lit("")), F.lit("\n   Tags: "), F.array_join(own, ", "))
    rows = rows.select("session_id", "tag", F.struct("pos", "id", text.alias("text")).alias("x"), own.alias("own"), left.alias("left"))
    rows = rows.groupBy("session_id", "tag").agg(F.array_sort(F.collect_list("x")).alias("x"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("own")))).alias("tags"), F.round(F.avg("left"), 2).alias("strength"))
    ids = F.transform("x", lambda y: y["id"])
    listed = F.array_join(F.transform("x", lambda y, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), y["text"])), "\n\n")
    before, after = template.split("{observations}")
    rows = rows.withColumns({"prompt": F.concat(F.lit(before), listed, F.lit(after)), "consolidates": ids})
    key = F.concat(F.lit("ref_"), F.substring(F.sha2(F.concat_ws("|", "session_id", "tag", F.array_join("consolidates", ",")), 256), 1, 16))
    rows = rows.withColumn("content", F.trim(generator(F.col("prompt"))))
    return rows.select(
        key.alias("key"), "session_id", "tag", "content", "tags", "consolidates", F.size("consolidates").cast("long").alias("source_count"), "strength",
        F.size(F.filter(F.split("prompt", r"\s+"), lambda w: w != "")).cast("long").alias("prompt_tokens"), embedder(F.col("content")).alias("embedding"),
    )


def nearest_rank(rows: DataFrame, group: str, value: str, parts: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Quantiles by nearest rank, halves to even. Equal values are counted first, so a group's work is in its distinct values, cut into
    ranges of about as many of them by approximate quantiles, outliers or not: counts of ranges say in which of them a rank lies, and only
    that one is sorted."""
    counts = saved(rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("times")))
    cuts = F.sort_array(F.percentile_approx(value, [n / RANGES for n in range(1, RANGES)], 4 * RANGES))
    # approximate cuts come out otherwise when they are made again, so they are made once
    ends = saved(counts.groupBy(F.col(group).alias("_group")).agg(F.sum("times").alias("all"), cuts.alias("cuts")))
    same = F.col(group).eqNullSafe(F.col("_group"))
    halves = F.array(*(F.lit(RANGES >> n) for n in range(1, RANGES.bit_length())))
    below = lambda lo, k: F.when((lo + k <= F.size("cuts")) & (F.get("cuts", lo + k - 1) < F.col(value)), lo + k).otherwise(lo)
    placed = counts.join(ends, same).withColumn("part", F.aggregate(halves, F.lit(0), below)).drop("cuts", "_group")
    before = placed.groupBy(F.col(group).alias("_group"), F.col("part").alias("_part")).agg(F.sum("times").alias("size"))
    along = W.partitionBy("_group").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = before.withColumn("before", F.coalesce(F.sum("size").over(along), F.lit(0))).select("_group", "_part", "before")
    within = W.partitionBy(group, "part").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ordered = placed.join(before, same & (F.col("part") == F.col("_part"))).withColumn("upto", F.col("before") + F.sum("times").over(within))
    rank = lambda p: F.bround((F.col("all") - 1) * p)
    picks = [F.max(F.when((rank(p) < F.col("upto")) & (rank(p) >= F.col("upto") - F.col("times")), F.col(value))).alias(f"p{round(p * 100)}") for p in parts]
    return ordered.groupBy(group).agg(*picks)


def spaced(values: Column, least: int) -> Column:
    """Of a sorted array, each element at least so far from the last one kept."""
    none = F.array().cast("array<int>")
    return F.aggregate(values, none, lambda acc, x: F.when((F.size(acc) == 0) | (x - F.get(acc, F.size(acc) - 1) >= least), F.concat(acc, F.array(x))).otherwise(acc))
