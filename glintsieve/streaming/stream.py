"""Scanning a stream: each micro-batch is scanned by the batch plan and written once."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import Options
from ..operators.groups import group_findings
from ..operators.rules import RuleSet
from ..operators.scan import candidates, findings
from ..sources.containers import MAX_BYTES, records

_LINE = "source string, stream string, time string, first_line long, last_line long, text string"
_STATE = "text string, time string, first_line long, last_line long"


def scan_stream(lines: DataFrame, rules: RuleSet, folder: str, checkpoint: str, options: Options | None = None, **trigger: Any) -> StreamingQuery:
    """Scans a stream of lines (source, line_no, byte_offset, line) into ``folder``.

    Each batch has a folder of its own, which is replaced if the batch is run again, so
    a restart neither loses nor repeats findings.
    """

    def write(batch: DataFrame, number: int) -> None:
        findings(candidates(batch, rules, options), options).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The groups of all findings that a stream has written so far."""
    return group_findings(spark.read.parquet(folder).drop("batch"))


def reassemble_stream(lines: DataFrame, max_bytes: int = MAX_BYTES, idle: str | None = None) -> DataFrame:
    """Container lines of a stream, joined for each source and stream; the state is the unfinished line.

    Lines that are no records pass, as in the batch form.  With ``idle``, like ``10
    minutes``, an unfinished line is passed on when its stream has been idle so long;
    such a query has to look for idle streams and never ends by itself.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0
    read = records(lines.where("line is not null")).withColumn("stream", F.coalesce("stream", F.lit("")))

    def join(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        source, stream = key
        held = list(state.get) if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append(held)
            held = None
        rows = pd.concat(list(batches)).sort_values("line_no") if not state.hasTimedOut else pd.DataFrame(columns=["line_no", "line", "log", "time"])
        for line_no, line, log, time in zip(rows["line_no"], rows["line"], rows["log"], rows["time"], strict=True):
            if not stream:
                out.append([line, None, line_no, line_no])
                continue
            held = [held[0] + log, held[1], held[2], line_no] if held else [log, time, line_no, line_no]
            if log.endswith("\n") or len(held[0].encode()) > max_bytes:
                out.append(held)
                held = None
        if held:
            state.update(tuple(held))
            if wait:
                state.setTimeoutDuration(wait)
        elif state.exists:
            state.remove()
        text = lambda t: t[:-2] if t.endswith("\r\n") else t.removesuffix("\n")
        yield pd.DataFrame([(source, stream, t, a, b, text(x)) for x, t, a, b in out], columns=["source", "stream", "time", "first_line", "last_line", "text"])

    return read.groupBy("source", "stream").applyInPandasWithState(join, _LINE, _STATE, "append", "ProcessingTimeTimeout" if idle else "NoTimeout")
