"""Log lines with exact places: which files are read, how they are split, and line numbers across splits.

A line ends at a line feed only; one carriage return before it is dropped.  Plain, gzip
and bzip2 files go through Spark's text reader.  The other compressed kinds are read
whole by one task a file, as they can't be split.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import os
import sys
from collections.abc import Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Suffixes of log files, of compressed files, and the units of sizes.
LOG_SUFFIXES = (".log", ".json", ".jsonl", ".ndjson", ".txt", ".out", ".gz", ".bz2", ".xz")
COMPRESSED = (".gz", ".tgz", ".bz2", ".xz", ".lzma")
UNITS = {"": 1, "b": 1, "k": 2**10, "kb": 2**10, "m": 2**20, "mb": 2**20, "g": 2**30, "gb": 2**30}
#: Lines of a page, whose lengths are shuffled together.
PAGE = 256
#: Read by Spark's text reader; other compressed files by a task each.
SPARK_READS = (".gz", ".bz2")


def parse_size(text: str) -> int:
    """Bytes of a size like ``8MB`` or ``512k``."""
    plain = text.strip().lower().replace("_", "")
    digits = plain.rstrip("kmgb")
    unit = plain[len(digits) :]
    try:
        size = int(float(digits) * UNITS[unit])
    except (ValueError, KeyError, OverflowError):
        raise ValueError(f"{text!r} is not a size") from None
    if size <= 0:
        raise ValueError(f"{text!r} is not a size above 0")
    return size


def format_bytes(size: int | None) -> str:
    """A size for people: bytes as they are, larger ones with a digit and a unit."""
    if size is None:
        return "unknown"
    value, units = float(size), ["KiB", "MiB", "GiB", "TiB"]
    if abs(value) < 1024:
        return f"{size} B"
    for unit in units:
        value /= 1024
        if abs(value) < 1024 or unit == units[-1]:
            break
    return f"{value:.1f} {unit}"


def peak_memory() -> int | None:
    """The most bytes that this process has held at once, where the machine tells."""
    try:
        import resource
    except ImportError:
        return None
    peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    return peak if sys.platform == "darwin" else peak * 1024


def source_kind(path: str) -> str:
    return "stream" if path == "-" else "compressed" if path.lower().endswith(COMPRESSED) else "seekable"


def resolve_inputs(paths: Sequence[str], recursive: bool = True, suffixes: Sequence[str] = LOG_SUFFIXES, all_files: bool = False) -> list[str]:
    """The files that paths name: files as they are, folders walked for log files in order, each file once.

    A path with a scheme, such as ``hdfs://`` or ``s3a://``, stays for Spark to read.
    """
    out: dict[str, str] = {}
    for given in paths:
        if given == "-":
            out.setdefault("-", "-")
            continue
        if "://" in given:  # of another store: Spark lists and opens it
            out.setdefault(given, given)
            continue
        path = Path(given).expanduser()
        if not path.exists():
            raise FileNotFoundError(given)
        found = [path] if path.is_file() else sorted(p for p in (path.rglob("*") if recursive else path.glob("*")) if p.is_file() and (all_files or p.suffix.lower() in suffixes))
        for file in found:
            out.setdefault(os.path.realpath(file), str(file))
    return list(out.values())


def without_return(raw: Column) -> Column:
    """A line's text without the carriage return before its end."""
    return F.regexp_replace(raw, r"\r\z", "")


def read_lines(spark: SparkSession, paths: Sequence[str], keep: Column | None = None) -> DataFrame:
    """(source, line_no, byte_offset, line, raw) of files; offsets are bytes of the decompressed file.

    ``raw`` is the line's bytes as they are, without its end; ``line`` is the text of it.
    An empty file has no lines, and a last line without an end counts.  With ``keep``, a
    condition on line, only lines that meet it are in the result, at the same places;
    all others are counted where they are read and never shuffled.
    """
    plain = [p for p in paths if source_kind(p) == "seekable" or p.lower().endswith(SPARK_READS)]
    other = [p for p in paths if p not in plain]
    parts = []
    if plain:
        parts.append(_text_lines(spark, plain, keep))
    if other:
        parts.append(_whole_files(spark, other) if keep is None else _whole_files(spark, other).where(keep))
    if not parts:
        return spark.createDataFrame([], "source string, line_no long, byte_offset long, line string, raw binary")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _text_lines(spark: SparkSession, paths: Sequence[str], keep: Column | None) -> DataFrame:
    """Places by what comes before in the block, and the sums of the blocks before it, which are few rows."""
    read = spark.read.text(list(paths), lineSep="\n").select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("raw")
    )
    bytes_of = F.octet_length("raw").cast("long") + 1
    placed, sums = _every_line(read, bytes_of) if keep is None else _kept_lines(read, bytes_of, keep)
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "block", "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))
    out = placed.join(sums, ["source", "block"])
    name = F.regexp_replace(F.url_decode("source"), r"\Afile:/+", "/")
    number = F.col("lines_before") + F.col("at") - F.col("first") + 1
    return out.select(name.alias("source"), number.alias("line_no"), (F.col("bytes_before") + F.col("inside")).alias("byte_offset"), _text_of("raw").alias("line"), _bytes_of("raw").alias("raw"))


def _text_of(raw: str) -> Column:
    return without_return(F.make_valid_utf8(F.col(raw).cast("string")))


def _bytes_of(raw: str) -> Column:
    return F.when(F.endswith(raw, F.lit(b"\r")), F.expr(f"substring({raw}, 1, octet_length({raw}) - 1)")).otherwise(F.col(raw))


def _every_line(read: DataFrame, bytes_of: Column) -> tuple[DataFrame, DataFrame]:
    """All lines with ``inside``, the bytes before them in their block; and the sums of blocks."""
    block = Window.partitionBy("source", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sums = read.groupBy("source", "block").agg(F.count(F.lit(1)).alias("lines"), F.sum(bytes_of).alias("bytes"), F.min("at").alias("first"))
    return read.withColumn("inside", F.coalesce(F.sum(bytes_of).over(block), F.lit(0))), sums


def _kept_lines(read: DataFrame, bytes_of: Column, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The same for lines that meet a condition.

    A block's lines are read one after the other by one task, so their numbers follow
    each other.  Tasks sum up pages of ``PAGE`` lines; of a line that is not kept only
    its length goes to its page, and a kept line finds its page by a join.
    """
    page = F.floor(F.col("at") / PAGE).alias("page")
    pages = read.groupBy("source", "block", page).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(bytes_of).alias("bytes"), F.min("at").alias("first"), F.collect_list(F.struct("at", bytes_of.alias("size"))).alias("sizes")
    )
    earlier = Window.partitionBy("source", "block").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    placed_pages = pages.select("source", "block", "page", "sizes", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("page_before"))
    kept = read.withColumn("line", _text_of("raw")).where(keep).select("source", "block", page, "at", "raw")
    joined = kept.join(placed_pages, ["source", "block", "page"])
    inside = F.aggregate("sizes", F.col("page_before"), lambda total, x: F.when(x["at"] < F.col("at"), total + x["size"]).otherwise(total))
    sums = pages.groupBy("source", "block").agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"), F.min("first").alias("first"))
    return joined.select("source", "block", "at", "raw", inside.alias("inside")), sums


def _open(path: str):
    if path.lower().endswith((".xz", ".lzma")):
        return lzma.open(path, "rb")
    return bz2.open(path, "rb") if path.lower().endswith(".bz2") else gzip.open(path, "rb")


def _whole_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files that only this process' libraries unpack, a task each, as streams; they must be on a path that workers see."""
    if remote := [p for p in paths if "://" in p]:
        raise ValueError(f"{remote[0]}: of other stores only plain, gzip and bzip2 files are read")
    named = spark.createDataFrame([(str(p),) for p in paths], "path string").repartition(len(paths))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows, offset = [], 0
                with _open(path) as file:
                    for n, raw in enumerate(file, 1):
                        line = raw.removesuffix(b"\n")
                        line = line.removesuffix(b"\r")
                        rows.append((path, n, offset, line.decode("utf-8", "replace"), line))
                        offset += len(raw)
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=["source", "line_no", "byte_offset", "line", "raw"])
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["source", "line_no", "byte_offset", "line", "raw"])

    return named.mapInPandas(read, "source string, line_no long, byte_offset long, line string, raw binary")


def table_lines(table: DataFrame, name: Column, text: Column) -> DataFrame:
    """(source, line_no, byte_offset, line) of a table whose rows are whole texts; a null text has no lines."""
    split = table.select(name.alias("source"), F.split(text, "\n").alias("_lines"))
    # A text that ends in a line feed has no line after it.
    split = split.withColumn("_lines", F.when(F.element_at("_lines", -1) == "", F.slice("_lines", 1, F.size("_lines") - 1)).otherwise(F.col("_lines")))
    out = split.select("source", "_lines", F.posexplode("_lines").alias("_at", "_line"))
    offset = F.aggregate(F.slice("_lines", 1, F.col("_at")), F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 1)
    return out.select("source", (F.col("_at") + 1).cast("long").alias("line_no"), offset.alias("byte_offset"), without_return(F.col("_line")).alias("line"))
