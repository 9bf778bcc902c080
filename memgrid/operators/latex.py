"""Environments of LaTeX texts, matched by a running depth, with their places; tables and sections made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MARK = r"\\(begin|end)\s*\{([A-Za-z]+\*?)\}"
SECTION = r"\\(section|subsection|subsubsection|paragraph)\*?\{([^}]+)\}"
#: Braces within braces, once.
BRACED = r"\{((?:[^{}]|\{[^{}]*\})*)\}"


def marks(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, n, hit, one, two, start, stop): the matches of a pattern with two groups, numbered, with their places in code points."""
    hits = lambda part: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(part))
    rows = docs.where(F.col(text).rlike(pattern)).select(key, F.posexplode(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits(0).alias("hit"), hits(1).alias("one"), hits(2).alias("two"))).alias("n", "x"))
    rows = rows.select(key, "n", F.col("x.hit").alias("hit"), F.col("x.one").alias("one"), F.col("x.two").alias("two"), F.length("x.gap").alias("gap"))
    size = F.coalesce(F.length("hit"), F.lit(0))
    rows = rows.withColumn("stop", F.sum(F.col("gap") + size).over(W.partitionBy(key).orderBy("n")))
    return rows.where("hit is not null").select(key, "n", "hit", "one", "two", (F.col("stop") - size).alias("start"), "stop")


def environments(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, depth, start, body_start, body_end, end) of matched environments; the outermost have depth 1.

    The depth is a running sum of begins and ends. Among the marks of one level a begin belongs to the end that comes next, if their names
    are equal; what stays open, or closes what isn't open, is left out.
    """
    rows = marks(docs, key, text, MARK)
    open_ = F.col("one") == "begin"
    depth = F.sum(F.when(open_, 1).otherwise(-1)).over(W.partitionBy(key).orderBy("n"))
    rows = rows.withColumn("depth", depth + F.when(open_, 0).otherwise(1))
    along = W.partitionBy(key, "depth").orderBy("n")
    following = lambda c: F.lead(c).over(along)
    rows = rows.withColumns({"then": following("one"), "name": following("two"), "body_end": following("start"), "end": following("stop")})
    rows = rows.where((F.col("one") == "begin") & (F.col("then") == "end") & (F.col("two") == F.col("name")))
    return rows.select(key, "name", "depth", "start", F.col("stop").alias("body_start"), "body_end", "end")


def between(text: str, start: Column | str, end: Column | str) -> Column:
    start, end = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    return F.col(text).substr(start.cast("int") + 1, (end - start).cast("int"))


def tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, depth, start, end, caption, label, column_spec, tabular) of each table environment, tables in tables too.

    Caption and label are the first ones of its body; tabular is the body of the first tabular or array in it, and column_spec what stands
    in braces before that. What isn't there is null.
    """
    found = environments(docs, key, text)
    outer = found.where(F.col("name").isin("table", "table*")).select(key, "depth", "start", "end", "body_start", "body_end")
    inner = found.where(F.col("name").isin("tabular", "array")).select(key, F.col("start").alias("at"), F.col("body_start").alias("from"), F.col("body_end").alias("to"))
    inside = outer.join(inner, key).where((F.col("at") >= F.col("body_start")) & (F.col("to") <= F.col("body_end")))
    first = inside.groupBy(key, "start").agg(F.min(F.struct("at", "from", "to")).alias("grid"))
    rows = outer.join(first, [key, "start"], "left").join(docs.select(key, text), key)
    rows = rows.withColumns({"body": between(text, "body_start", "body_end"), "whole": F.when(F.col("grid").isNotNull(), between(text, F.col("grid.from"), F.col("grid.to")))})
    spec = r"(?s)^\s*(?:\[[^\]]*\])?\s*" + BRACED
    found_in = lambda c, pattern: F.when(F.col(c).rlike(pattern), F.regexp_extract(c, pattern, 1))
    return rows.select(
        key, "depth", "start", "end",
        found_in("body", r"\\caption\s*" + BRACED).alias("caption"), found_in("body", r"\\label\{([^}]+)\}").alias("label"),
        found_in("whole", spec).alias("column_spec"), F.trim(F.regexp_replace("whole", spec, "")).alias("tabular"),
    )


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, level, title, start) of section commands, in their order."""
    return marks(docs, key, text, SECTION).select(key, F.col("one").alias("level"), F.col("two").alias("title"), "start")
