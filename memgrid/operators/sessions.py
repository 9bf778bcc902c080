"""Records of sessions: recall logs, envelopes of prompts, keys and metadata, and what context is worth."""

from __future__ import annotations

import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import scores


def recall_rows(rows: DataFrame) -> DataFrame:
    """(key, session_id, query, result_count, duration_ms, created_at, notes) from rows without key; empty notes are null. The key says what was asked when."""
    notes = F.nullif("notes", F.lit(""))
    key = F.sha2(F.concat_ws("|", F.col("session_id").cast("string"), "query", F.col("created_at").cast("string")), 256)
    return rows.select(key.alias("key"), "session_id", "query", F.col("result_count").cast("long").alias("result_count"), F.col("duration_ms").cast("double").alias("duration_ms"), "created_at", notes.alias("notes"))


def append_recall(rows: DataFrame, path: str) -> None:
    recall_rows(rows).write.mode("append").parquet(path)


def merged(base: Column, over: Column) -> Column:
    """Two maps of strings in one, the second one's entries first."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)


def deep_merged(base: Column, over: Column) -> Column:
    """Two maps of maps in one: maps of the same name are merged, the second one's entries win."""
    return F.map_zip_with(base, over, lambda k, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(merged(a, b)))


def _merge(base: object, over: object) -> object:
    if isinstance(base, dict) and isinstance(over, dict):
        return {k: _merge(base[k], over[k]) if k in base and k in over else over.get(k, base.get(k)) for k in [*base, *(k for k in over if k not in base)]}
    return over


@F.pandas_udf(StringType())
def deep_merged_json(base: pd.Series, over: pd.Series) -> pd.Series:
    """Two JSON objects merged at any depth: objects of the same name are merged, anything else of the second one wins, null too. A null text is an empty object."""
    load = lambda x: {} if x is None else json.loads(x)
    return pd.Series([json.dumps(_merge(load(a), load(b)), ensure_ascii=False, sort_keys=True, separators=(",", ":")) for a, b in zip(base, over, strict=True)])


def envelope(overrides: Column, extra: Column, stop: Column) -> Column:
    """Settings of a call: overrides, then extra, and the stop words (joined by |) where there are some and none are set."""
    both = merged(overrides, extra)
    return F.when((stop != "") & ~F.map_contains_key(both, F.lit("stop")), F.map_concat(both, F.create_map(F.lit("stop"), stop))).otherwise(both)


def context(parts: Mapping[str, Column], weights: Mapping[str, float] | None = None) -> Column:
    """The weighted sum of context components, a quarter each if no weights are given."""
    out = F.lit(0.0)
    for name, value in parts.items():
        out = out + value * F.lit((weights or {}).get(name, 0.25))
    return out


def boundary(label: Column, out_leg: Column, in_leg: Column, parts: Mapping[str, Column], link: Column, alpha: Column) -> list[Column]:
    """Columns of a boundary's record: its label, context, link and alpha, and the pair's score."""
    whole = context(parts)
    pair = scores.pair_score(out_leg, in_leg, whole, link, alpha)
    return [label.alias("label"), whole.alias("context"), link.alias("link"), alpha.alias("alpha"), pair.alias("score")]


def timestamp_key(prefix: str, at: Column, salt: Column) -> Column:
    """prefix_time_xxxxxxxx: the time in ISO form with dashes, then eight hex digits of a hash of the salt, so that reruns agree."""
    return F.concat_ws("_", F.lit(prefix), F.concat(F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss.SSSSSS"), F.lit("Z")), F.substring(F.md5(salt), 1, 8))


def parsed_time(text: Column) -> Column:
    """ISO text as a timestamp, a final Z as UTC; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def metadata_block(edited: Column, messages: Column, archived: Column, tags: Column) -> Column:
    """The lines that tell a model what lies outside of its context; archive lines only where there is something."""
    return F.concat_ws(
        "\n",
        F.lit("<memory_metadata>"),
        F.concat(F.lit("- Memory last updated: "), F.date_format(edited, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")),
        F.concat(F.lit("- "), messages.cast("string"), F.lit(" previous messages stored in recall memory")),
        F.when(archived > 0, F.concat(F.lit("- "), archived.cast("string"), F.lit(" total items in archival memory"))),
        F.when(F.size(tags) > 0, F.concat(F.lit("- Available archival memory tags: "), F.array_join(F.sort_array(tags), ", "))),
        F.lit("</memory_metadata>"),
    )


def coerced(text: Column) -> Column:
    """(kind, value) of a setting's text: a boolean's words (1 and 0 among them) come first, then numbers, with a point as double, else text."""
    low = F.lower(text)
    kind = F.when(low.isin("true", "yes", "1", "on"), "true").when(low.isin("false", "no", "0", "off"), "false")
    number = F.when(text.contains("."), F.when(text.try_cast("double").isNotNull(), "float")).when(text.try_cast("long").isNotNull(), "int")
    kind = F.coalesce(kind, number, F.lit("text"))
    return F.struct(kind.alias("kind"), F.when(kind.isin("float", "int"), text.try_cast("double")).alias("number"))
