"""Sinks: JSON lines, graph exports, tables, and idempotent appends."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.indexing import dense_index
from .stage import saved


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_texts(rows: DataFrame, folder: str) -> None:
    """Rows (name, text) as files <name>.txt below folder, each with a zero byte at its end; of rows with one name the later ones lie in
    folders of their own. Names should not begin with a dot or an underscore, which readers skip; a slash in them becomes %2F.

    Tasks write the files themselves, by Arrow, into a folder a task, so no folder is made and nothing is renamed for a file. On file
    systems that Arrow can't open Spark's writer makes a folder of each name.
    """
    rows = rows.select(F.coalesce("name", F.lit("none")).alias("name"), "text").repartition("name")
    try:
        fs.FileSystem.from_uri(folder)
    except (ValueError, NotImplementedError, OSError):
        numbered = rows.withColumn("name", F.concat_ws("-", "name", F.monotonically_increasing_id()))
        return numbered.write.partitionBy("name").option("lineSep", "\0").text(folder)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        path = f"{path}/part={TaskContext.get().partitionId()}"
        system.create_dir(path)
        seen: dict[str, int] = {}
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n = seen[name] = seen.get(name, -1) + 1
                at = f"{path}/again={n}" if n else path
                if n:
                    system.create_dir(at)
                with system.open_output_stream(f"{at}/{quote(name, safe=' ')}.txt", compression=None) as out:
                    if text.is_valid:
                        out.write(text.as_buffer())
                    out.write(b"\0")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    rows.mapInArrow(f, "n long").agg(F.sum("n")).collect()


def appended(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The incoming rows that are new, one for each key, in the existing table's columns: what an append of them would write."""
    first = incoming.dropDuplicates([key])
    return first.join(existing.select(key), key, "left_anti").select(*existing.columns)


def append_turn(messages: DataFrame, path: str) -> None:
    """Appends turns; missing token counts are 0."""
    messages.withColumn("tokens", F.coalesce("tokens", F.lit(0))).write.mode("append").parquet(path)


def export_graph(vertices: DataFrame, edges: DataFrame, path: str, splits: DataFrame | None = None) -> None:
    """Vertices with their index from 0 in the order of their ids, edges split by kind with the indexes of their ends, the map from id to
    index as JSON lines, and splits (id, part) by index. vertices (id, ...), edges (src, dst, kind, ...); edges to what isn't there stay
    out."""
    if "id" not in vertices.columns:
        vertices.write.mode("overwrite").parquet(f"{path}/vertices")
        edges.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/edges")
        return
    placed = saved(dense_index(vertices, "id", "n"))
    placed.write.mode("overwrite").parquet(f"{path}/vertices")
    ids = placed.select("id", "n")
    ids.write.mode("overwrite").json(f"{path}/id_map")
    end = lambda rows, c: rows.join(ids.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n")), c)
    end(end(edges, "src"), "dst").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/edges")
    if splits is not None:
        splits.join(ids, "id").select("n", "part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/splits")


def log_records(rows: DataFrame, path: str | None = None, dry_run: bool = False) -> DataFrame:
    """Records (columns of any kind, nested ones too) as (record: JSON), appended to a log of JSON lines unless there is no path or it is a dry run."""
    lines = rows.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("record"))
    if path and not dry_run:
        lines.write.mode("append").text(path)
    return lines


def keyed_edges(edges: DataFrame, parts: Sequence[str] = ()) -> DataFrame:
    """Edges with a key made of what they say, each once, so that writing them again changes nothing: their ends, their kind, and the name
    of what is referred to where they have one."""
    parts = parts or [c for c in ("src", "dst", "kind", "name") if c in edges.columns]
    return edges.withColumn("key", F.sha2(F.to_json(F.struct(*parts)), 256)).dropDuplicates(["key"])


def create_table(spark: SparkSession, name: str, schema: str, partition: Sequence[str] = ()) -> None:
    by = f" partitioned by ({', '.join(partition)})" if partition else ""
    spark.sql(f"create table if not exists {name} ({schema}) using parquet{by}")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"drop table if exists {name}")
