"""Container logs: records of one JSON object a line, and lines that were split over several of them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.leaves import parse

#: Bytes after which a line that doesn't end is passed on as it is.
MAX_BYTES = 1 << 20


def parse_record(line: str) -> tuple[str, str, str | None] | None:
    """(log, stream, time) of a record: ``log`` a string, ``stream`` one that isn't empty (stdout if missing), ``time`` a string or null."""
    record = parse(line)
    if not isinstance(record, dict) or not isinstance(record.get("log"), str):
        return None
    stream, time = record.get("stream", "stdout"), record.get("time")
    if not isinstance(stream, str) or not stream or not isinstance(time, str | None):
        return None
    return record["log"], stream, time


def records(lines: DataFrame) -> DataFrame:
    """``lines`` with log, stream and time; all null for a line that is no record."""

    @F.pandas_udf("log string, stream string, time string")
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parse_record(x or "") or (None, None, None) for x in batch], columns=["log", "stream", "time"], dtype=object)

    return lines.withColumn("_r", parsed("line")).select(*lines.columns, "_r.*")


def _joined(parts: Column, max_bytes: int) -> Column:
    """Lines from the parts of one island in order: a new one begins where the one before has ended or grown too long."""
    def merge(state: Column, part: Column) -> Column:
        last = F.try_element_at(state, F.lit(-1))
        grows = last["open"] & (F.octet_length(last["text"]) <= max_bytes)
        more = F.struct(F.concat(last["text"], part["log"]).alias("text"), last["time"].alias("time"), last["first_line"].alias("first_line"), part["line_no"].alias("last_line"), (~part["log"].endswith("\n")).alias("open"))
        new = F.struct(part["log"].alias("text"), part["time"].alias("time"), part["line_no"].alias("first_line"), part["line_no"].alias("last_line"), (~part["log"].endswith("\n")).alias("open"))
        return F.when(F.coalesce(grows, F.lit(False)), F.concat(F.slice(state, 1, F.size(state) - 1), F.array(more))).otherwise(F.concat(state, F.array(new)))

    empty = F.array().cast("array<struct<text:string,time:string,first_line:bigint,last_line:bigint,open:boolean>>")
    return F.aggregate(parts, empty, merge)


def reassemble(lines: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(source, stream, time, first_line, last_line, text) from ``lines`` (source, line_no, line).

    The records of a source's stream are joined until one ends in a line feed, or the
    joined text is longer than ``max_bytes``; time is the first record's.  What is left
    at the end is a line as well.  Lines that are no records pass with an empty stream
    and a null time, and null lines are dropped.
    """
    read = records(lines.where("line is not null")).select("source", F.col("line_no").cast("bigint").alias("line_no"), "line", "log", "stream", "time")
    other = read.where("log is null").select("source", F.lit("").alias("stream"), F.lit(None).cast("string").alias("time"), F.col("line_no").alias("first_line"), F.col("line_no").alias("last_line"), F.col("line").alias("text"))
    ended = F.when(F.col("log").endswith("\n"), 1).otherwise(0)
    before = Window.partitionBy("source", "stream").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    islands = read.where("log is not null").withColumn("island", F.coalesce(F.sum(ended).over(before), F.lit(0)))
    parts = islands.groupBy("source", "stream", "island").agg(F.array_sort(F.collect_list(F.struct("line_no", "log", "time"))).alias("parts"))
    made = parts.select("source", "stream", F.explode(_joined(F.col("parts"), max_bytes)).alias("x"))
    done = made.select("source", "stream", "x.time", "x.first_line", "x.last_line", F.regexp_replace("x.text", r"\r?\n\z", "").alias("text"))
    return done.unionByName(other)


def as_record(log: str, stream: str = "stdout", time: str | None = None) -> str:
    """A record's line, for tests and samples."""
    return json.dumps({"log": log, "stream": stream} | ({"time": time} if time else {}))
