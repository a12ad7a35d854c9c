import bz2
import gzip
import io
import json
import lzma
import sys

import pytest
from pyspark.sql import functions as F

from glintsieve import cli
from glintsieve.operators.rules import load_rules
from glintsieve.sources.containers import as_record, parse_record, reassemble
from glintsieve.sources.lines import format_bytes, parse_size, peak_memory, read_lines, resolve_inputs, source_kind, table_lines
from glintsieve.streaming.stream import reassemble_stream, scan_stream, stream_groups

from samples import positives

RAW = b"one\r\ntwo\n\nfo\xc3\xbcr\xff\rx\n" + b"".join(b"line %d\n" % i for i in range(3000)) + b"last"


def expected(raw):
    out, offset = [], 0
    for n, line in enumerate(raw.split(b"\n"), 1):
        out.append((n, offset, line.removesuffix(b"\r")))
        offset += len(line) + 1
    return out[:-1] if raw.endswith(b"\n") else out


def test_lines_and_offsets(spark, tmp_path):
    """All kinds of files in one read; the long plain one is several splits."""
    want = {}
    for n, raw in enumerate([RAW, RAW + b"\n", b"\n", b"x"]):
        for suffix, pack in ((".log", bytes), (".log.gz", gzip.compress), (".log.bz2", bz2.compress), (".log.xz", lzma.compress)):
            path = tmp_path / f"a {n}{suffix}"
            path.write_bytes(pack(raw))
            want[str(path)] = expected(raw)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "15000")
    try:
        rows = read_lines(spark, list(want)).orderBy("source", "line_no").collect()
        kept = read_lines(spark, list(want), F.col("line").rlike("[27x]")).orderBy("source", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {}
    for r in rows:
        got.setdefault(r.source, []).append((r.line_no, r.byte_offset, bytes(r.raw)))
    assert got == want
    assert kept == [r for r in rows if set(r.line) & set("27x")] and len(kept) > 1000


def test_empty_file_and_several(spark, tmp_path):
    (tmp_path / "e.log").write_bytes(b"")
    (tmp_path / "f.log").write_bytes(b"x\ny")
    assert read_lines(spark, [str(tmp_path / "e.log")]).collect() == []
    assert read_lines(spark, [str(tmp_path / "e.log"), str(tmp_path / "f.log")]).count() == 2
    assert read_lines(spark, []).collect() == []


def test_inputs(tmp_path):
    for name in ("b.log", "a.txt", "c.bin", "sub/d.gz"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    names = lambda paths, **k: [p[len(str(tmp_path)) + 1 :] for p in resolve_inputs(paths, **k)]
    assert names([str(tmp_path)]) == ["a.txt", "b.log", "sub/d.gz"]
    assert names([str(tmp_path)], recursive=False, all_files=True) == ["a.txt", "b.log", "c.bin"]
    assert names([str(tmp_path / "c.bin"), str(tmp_path / "sub" / ".." / "c.bin")]) == ["c.bin"]
    assert resolve_inputs(["-", "-"]) == ["-"]
    with pytest.raises(FileNotFoundError):
        resolve_inputs([str(tmp_path / "none")])
    assert [source_kind(p) for p in ("-", "x.tgz", "X.GZ", "x.log")] == ["stream", "compressed", "compressed", "seekable"]


def test_sizes():
    assert [parse_size(x) for x in ("8MB", "512k", "1_000", "2g", "7b")] == [8 << 20, 512 << 10, 1000, 2 << 30, 7]
    for bad in ("", "abc", "0", "-5", "10tb"):
        with pytest.raises(ValueError):
            parse_size(bad)


def test_table_lines(spark):
    table = spark.createDataFrame([(1, "a\r\nü\n"), (2, ""), (3, None), (4, "x\n\ny")], "id long, t string")
    rows = table_lines(table, F.col("id").cast("string"), F.col("t")).orderBy("source", "line_no").collect()
    assert [tuple(r) for r in rows] == [("1", 1, 0, "a"), ("1", 2, 3, "ü"), ("4", 1, 0, "x"), ("4", 2, 2, ""), ("4", 3, 3, "y")]


CONTAINER = [
    as_record("whole\n", time="t1"), "plain text", as_record("first ", time="t2"), as_record("err ", "stderr"), as_record("second\r\n", time="t3"), '{"log": 5}', '{"log": "x", "stream": ""}',
    as_record("more\n", "stderr"), as_record("x" * 30), as_record("y" * 30), as_record("open"), "{broken",
]
JOINED = {
    ("stdout", "t1", 1, 1, "whole"), ("", None, 2, 2, "plain text"), ("stdout", "t2", 3, 5, "first second"), ("stderr", None, 4, 8, "err more"), ("", None, 6, 6, '{"log": 5}'),
    ("", None, 7, 7, '{"log": "x", "stream": ""}'), ("stdout", None, 9, 10, "x" * 30 + "y" * 30), ("stdout", None, 11, 11, "open"), ("", None, 12, 12, "{broken"),
}


def test_containers(spark):
    lines = spark.createDataFrame([("c", i + 1, x) for i, x in enumerate(CONTAINER)] + [("d", 1, None)], "source string, line_no long, line string")
    got = reassemble(lines, max_bytes=40).collect()
    assert {tuple(r)[1:] for r in got} == JOINED and len(got) == len(JOINED)
    assert parse_record('{"log": "a", "time": 3}') is None and parse_record('{"log": "a"}') == ("a", "stdout", None)


def test_container_stream(spark, tmp_path):
    schema = "source string, line_no long, line string"
    lines = spark.createDataFrame([("c", i + 1, x) for i, x in enumerate(CONTAINER)], schema)
    for part in ("line_no <= 4", "line_no > 4"):  # the state outlives the first run
        lines.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = reassemble_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), max_bytes=40)
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        if not query.awaitTermination(120):
            query.stop()
            pytest.fail("the stream does not end")
    got = {tuple(r)[1:] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == JOINED - {("stdout", None, 11, 11, "open")}  # not ended yet


def test_scan_stream(spark, tmp_path):
    key = positives()["mailgun-api-key"]
    schema = "source string, line_no long, byte_offset long, line string"
    lines = spark.createDataFrame([("s", i, 0, f"{key} {i}") for i in range(10)], schema)
    for part in range(2):
        lines.where(f"line_no % 2 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        scan_stream(stream, load_rules(), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    row = stream_groups(spark, str(tmp_path / "out")).collect()
    assert [(r.secret, r.occurrences) for r in row] == [(key, 10)]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    key = positives()["github-personal-access-token"]
    log = tmp_path / "x.log"
    log.write_text(f"start {key}\nend\n")
    assert cli.main(["scan", str(log), "--format", "json", "--output", str(tmp_path / "r.json"), "--write-baseline", str(tmp_path / "b.json"), "--stats"]) == cli.FOUND
    made = json.loads((tmp_path / "r.json").read_text())
    assert [(f["rule_id"], f["line"], f["column"], f["source"]) for f in made["findings"]] == [("github-personal-access-token", 1, 7, str(log))]
    assert cli.main(["scan", str(log), "--baseline", str(tmp_path / "b.json")]) == cli.CLEAN
    assert cli.main(["scan", str(log), "--fail-on", "none"]) == cli.CLEAN
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(f"a {key}".encode())))
    assert cli.main(["scan", "-"]) == cli.FOUND
    assert cli.main(["redact", str(log), "--output-dir", str(tmp_path / "out")]) == cli.CLEAN
    assert key not in (tmp_path / "out" / "x.log").read_text()
    assert cli.main(["redact", str(log), "--output-dir", str(tmp_path / "out")]) == cli.FAILED
    assert cli.main(["redact", str(log), "--output-dir", str(tmp_path), "--force"]) == cli.FAILED
    assert cli.main(["scan", str(tmp_path / "none.log")]) == cli.FAILED
    assert cli.main(["rules-list", "--pack", "aws"]) == cli.CLEAN and "7 rules" in capsys.readouterr().out
    assert cli.main(["rules-show", "mailgun-api-key"]) == cli.CLEAN and cli.main(["rules-show", "nope"]) == cli.FAILED
    assert cli.main(["scan", str(log), "--include-rule", "nope"]) == cli.FAILED
    assert cli.main(["version"]) == cli.CLEAN
    capsys.readouterr()
    log.write_text(f"start {key}\n{positives(3)['github-personal-access-token']}\n")
    (tmp_path / "folder.log").mkdir()
    assert cli.main(["scan", str(log), "--max-findings", "1", "--format", "json", "--stats"]) == cli.FOUND
    told = capsys.readouterr()
    stats = json.loads(told.out)["stats"]
    assert stats["truncated_sources"] == [str(log)] and stats["lines"] == 2 and stats["bytes_scanned"] == log.stat().st_size and "only the first 1" in told.err
    assert cli.main(["scan", str(log), "--quiet"]) == cli.FOUND and len(capsys.readouterr().out.splitlines()) == 2
    assert cli.main(["scan", str(log), "--verbose"]) == cli.FOUND and "fingerprint" in capsys.readouterr().out
    assert cli.main(["rules-list", "--pack", "aws", "--show-pattern", "--write", str(tmp_path / "pages")]) == cli.CLEAN and "AKIA|ASIA" in capsys.readouterr().out
    assert sorted(p.name for p in (tmp_path / "pages").iterdir()) == ["aws.md", "index.md"]
    assert cli.main(["selftest"]) == cli.CLEAN and "found 66/66" in capsys.readouterr().out
    assert cli.main(["benchmark", "--size", "256k", "--secret-ratio", "0.01"]) == cli.CLEAN and "MiB/s" in capsys.readouterr().out


def test_unreadable_inputs_are_reported(spark, tmp_path, capsys, monkeypatch):
    log = tmp_path / "x.log"
    log.write_text("a " + positives()["github-personal-access-token"])
    monkeypatch.setattr(cli, "resolve_inputs", lambda paths, *a, **k: [*paths, str(tmp_path / "gone.log")])
    assert cli.main(["scan", str(log), "--format", "json"]) == cli.FAILED
    told = capsys.readouterr()
    made = json.loads(told.out)
    assert len(made["findings"]) == 1 and "gone.log" in made["summary"]["errors"][0] and "gone.log" in told.err


def test_made_up_log(spark):
    from glintsieve.operators.samples import made_up_log, placeholder_text

    rows = made_up_log(spark, 400_000, 0.01).collect()
    assert abs(sum(len(r.line) + 1 for r in rows) / 400_000 - 1) < 0.25
    assert 0.3 < sum(r.line.startswith("{") for r in rows) / len(rows) < 0.5
    assert made_up_log(spark, 400_000, 0.01).collect() == rows
    text = placeholder_text("key {hex:40} and {other} {b64:x}")
    assert len(text) == len("key  and {other} {b64:x}") + 40 and "{hex" not in text


def test_sizes_for_people():
    assert [format_bytes(x) for x in (0, 1023, 1024, 5 * 2**20, 3 * 2**40, None)] == ["0 B", "1023 B", "1.0 KiB", "5.0 MiB", "3.0 TiB", "unknown"]
    assert peak_memory() is None or peak_memory() > 2**20
