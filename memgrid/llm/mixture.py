"""Mixing sources to target weights by Sainte-Laguë apportionment.

Only DataFrame functions are used. Sources get targets by weight, capped, the excess reshared (water filling over the sorted ratios of
cap to weight, which is what repeated resharing ends at). Targets in equal-token blocks are apportioned to sources by highest
quotients, then each source's blocks to its shards. In a shard documents stand in a seeded order; the quota is whole passes over the
shard plus the first blocks of that order, so a document at the end of the last block is taken in part.

A shard is a bounded number of documents chosen by a hash of doc_id, so a source with a third of all rows is many shards. Only tables
with a row for each source or shard are sorted as a whole.

Defined results: a null text has size 0 and nothing is taken of it; a null source is a source of its own and comes last; a null
doc_id is hashed as an empty string; repeated rows are documents of their own, ordered by size where ids tie; sources without words
get target 0; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import base

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 32
SHARD_DOCS = 2000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(base.WORD)), F.lit(0)).cast("long")


def apportioned(cells: DataFrame, group: Sequence[str], order: str, share: Column, seats: Column) -> DataFrame:
    """Adds `quota`: the seats of a cell by Sainte-Laguë within its group; ties go to the cell that comes first in `order`.

    share: the cell's part of its group's weight; seats: those of the group. Rounded shares are a start; what is missing or too much
    then goes by highest, or from the lowest, quotients. No cell can gain or lose more than its part of the difference and of the
    number of cells, plus one: only so many quotients are made for it.
    """
    whole = W.partitionBy(*group)
    cells = cells.withColumns({"_share": F.coalesce(share, F.lit(0.0)), "_seats": seats.cast("long")})
    cells = cells.withColumn("_start", F.floor(F.col("_share") * F.col("_seats") + 0.5).cast("long"))
    cells = cells.withColumns({"_less": F.col("_seats") - F.sum("_start").over(whole), "_cells": F.count(F.lit(1)).over(whole)})
    most = F.ceil(F.col("_share") * (F.abs("_less") + F.col("_cells"))).cast("long") + 1
    steps = F.when(F.col("_share") > 0, F.when(F.col("_less") < 0, F.least(most, F.col("_start"))).otherwise(most)).otherwise(0)
    steps = cells.where(F.col("_less") != 0).select(*group, order, "_share", "_start", "_less", F.explode(F.when(steps > 0, F.sequence(F.lit(0).cast("long"), steps - 1)).otherwise(F.array().cast("array<bigint>"))).alias("_step"))
    at = F.when(F.col("_less") > 0, F.col("_start") + F.col("_step")).otherwise(F.col("_start") - F.col("_step") - 1)
    steps = steps.withColumn("_quotient", F.col("_share") / (2 * at + 1))
    ranked = F.row_number().over(W.partitionBy(*group).orderBy(F.when(F.col("_less") > 0, -F.col("_quotient")).otherwise(F.col("_quotient")), F.when(F.col("_less") > 0, F.col(order)).otherwise(-F.col(order)), "_step"))
    moved = steps.withColumn("_rank", ranked).where(F.col("_rank") <= F.abs("_less")).groupBy(*group, order).agg(F.sum(F.signum("_less").cast("long")).alias("_moved"))
    return cells.join(moved, [*group, order], "left").withColumn("quota", F.col("_start") + F.coalesce("_moved", F.lit(0))).drop("_share", "_seats", "_start", "_less", "_cells", "_moved")


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, rank, docs, source_size, total, target) for rows (source, size)."""
    sources = sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    sources = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = sources.withColumns({"weight": weight, "cap": F.col("source_size") * cap, "total": F.sum("source_size").over(W.partitionBy())})
    sources = sources.withColumn("ratio", F.col("cap") / F.col("weight"))
    along = W.orderBy("ratio", "rank")
    before = F.coalesce(F.sum("cap").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(along.rowsBetween(0, W.unboundedFollowing))
    sources = sources.withColumn("level", (F.col("total") * share - before) / left)
    sources = sources.withColumn("level", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(W.partitionBy()))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap").cast("double")))
    return sources.select("source", "rank", "docs", "source_size", "total", target.alias("target"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for each document: how many of its words the mix takes, repeats counted."""
    hashed = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = base.written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hashed.alias("place")), "sizes")
    sources = targets(sized, weights, share, cap)
    part = F.try_divide(F.col("target"), F.col("total") * share)
    seats = F.floor(F.col("total") * share / block_words + 0.5)
    sources = apportioned(sources, [], "rank", part, seats).withColumnRenamed("quota", "blocks")
    sources = base.written(sources.withColumn("shards", F.ceil(F.col("docs") / shard_docs).cast("long")), "sources")
    own = sources.select(F.col("source").alias("_source"), "rank", "source_size", "target", "blocks", "shards")
    shard = F.pmod(F.conv(F.substring("place", 1, 8), 16, 10).cast("long"), F.col("shards"))
    rows = sized.join(own, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", shard)
    cells = rows.groupBy("rank", "shard", "blocks", "source_size").agg(F.sum("size").alias("shard_size"))
    cells = apportioned(cells, ["rank"], "shard", F.try_divide(F.col("shard_size"), F.col("source_size")), F.col("blocks"))
    words = F.least(F.col("quota") * block_words, F.col("shard_size") * cap)
    cells = cells.select("rank", "shard", "shard_size", words.alias("words"))
    passes = F.coalesce(F.floor(F.try_divide(F.col("words"), F.col("shard_size"))), F.lit(0)).cast("long")
    cells = cells.withColumn("passes", passes).withColumn("rest", F.col("words") - F.col("passes") * F.col("shard_size"))
    rows = rows.join(cells, ["rank", "shard"])
    before = F.coalesce(F.sum("size").over(W.partitionBy("rank", "shard").orderBy("place", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = F.col("passes") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - before))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source")


def op6_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(base.documents(spark, sf_dir)).drop("source")


def _quotas(cells: str, group: str, order: str, share: str, seats: str, prefix: str) -> str:
    """CTEs `{prefix}` with a quota for each row of `cells`."""
    by = f"partition by {group}" if group else ""
    keys = f"{group}, {order}" if group else order
    return f"""
{prefix}a as (select *, coalesce({share}, 0.0)::double part, ({seats})::bigint seats from {cells}),
{prefix}b as (select *, floor(part * seats + 0.5)::bigint start from {prefix}a),
{prefix}c as (select *, seats - sum(start) over ({by}) less, count(*) over ({by}) cells from {prefix}b),
{prefix}d as (select *, unnest(range(case when part > 0 and less > 0 then ceil(part * (abs(less) + cells))::bigint + 1
    when part > 0 and less < 0 then least(ceil(part * (abs(less) + cells))::bigint + 1, start) else 0 end)) step from {prefix}c where less <> 0),
{prefix}e as (select *, part / (2 * (case when less > 0 then start + step else start - step - 1 end) + 1) quotient from {prefix}d),
{prefix}f as (select *, row_number() over ({by} order by case when less > 0 then -quotient else quotient end, case when less > 0 then {order} else -{order} end, step) n from {prefix}e),
{prefix}g as (select {keys}, sum(sign(less))::bigint moved from {prefix}f where n <= abs(less) group by {keys}),
{prefix} as (select c.*, start + coalesce(moved, 0) quota from {prefix}c c left join {prefix}g g using ({keys}))"""


ORACLE_SQL = f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all("text", '[^\\x20\\x09-\\x0D]+')), 0)::bigint size, md5(concat('{SEED}', coalesce(doc_id::varchar, ''))) place from documents),
s as (select source, count(*) docs, sum(size)::bigint source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) rank from s),
w as (select *, case (rank - 1) % 3 when 0 then 3 when 1 then 1 else 2 end weight, source_size * 2 cap, (sum(source_size) over ())::bigint total from r),
x as (select *, cap / weight ratio from w),
y as (select *, (total * 1.5::double - coalesce(sum(cap) over (order by ratio, rank rows between unbounded preceding and 1 preceding), 0)::bigint)
    / (sum(weight) over (order by ratio, rank rows between current row and unbounded following))::bigint level from x),
z as (select *, max(case when ratio >= level then level end) over () common from y),
t as (select source, rank, docs, source_size, total, least(cap::double, coalesce(weight * common, cap::double)) target from z),
{_quotas("t", "", "rank", "target / nullif(total * 1.5::double, 0)", f"floor(total * 1.5::double / {BLOCK_WORDS} + 0.5)", "q")},
o as (select *, ceil(docs / {SHARD_DOCS})::bigint shards from q),
m as (select d.*, o.rank, o.source_size, o.target, o.quota blocks, ('0x' || substr(place, 1, 8))::bigint % shards shard from d join o on d.source is not distinct from o.source),
k as (select rank, shard, blocks, source_size, sum(size)::bigint shard_size from m group by all),
{_quotas("k", "rank", "shard", "shard_size / nullif(source_size, 0)", "blocks", "u")},
v as (select rank, shard, shard_size, least(quota * {BLOCK_WORDS}, shard_size * 2) words from u),
n as (select *, coalesce(words // nullif(shard_size, 0), 0)::bigint passes from v)
select doc_id, size, source_size, target, (passes * size + greatest(0, least(size, words - passes * shard_size
    - coalesce(sum(size) over (partition by rank, shard order by place, size rows between unbounded preceding and 1 preceding), 0))))::bigint taken
from m join n using (rank, shard)
"""
