"""The command line: scan, redact, rules, selftest, benchmark, version."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import groups, redact, report
from .operators.detect import Options
from .operators.rules import SEVERITIES, RuleError, RuleSet, load_rules
from .operators.samples import NEGATIVES, SECRET_SHARE, made_up_log, positives, selftest
from .operators.scan import candidates, capped, findings, screen_of, truncated_sources
from .sources.lines import format_bytes, parse_size, peak_memory, read_lines, resolve_inputs, source_kind

# What the process ends with.
CLEAN, FOUND, FAILED = 0, 1, 2


def _selection(parser: argparse.ArgumentParser) -> None:
    add = parser.add_argument
    add("--rules", action="append", default=[], help="a file or folder of rules; its rules replace built-in ones with their id")
    add("--no-builtin-rules", action="store_true")
    for name in ("include-rule", "exclude-rule", "enable-rule", "pack", "tag"):
        add(f"--{name}", action="append", default=[])
    add("--aggressive", action="store_true", help="switches on every rule")
    add("--min-severity", choices=SEVERITIES)
    add("--min-entropy", type=float)


def _reading(parser: argparse.ArgumentParser) -> None:
    add = parser.add_argument
    add("paths", nargs="+")
    add("--no-recursive", action="store_true")
    add("--all-files", action="store_true")
    add("--no-structured", action="store_true")
    add("--no-nested-json", action="store_true")
    add("--decode-base64", action="store_true")
    add("--max-line-bytes", type=parse_size, default=Options.max_line_bytes)
    add("--min-confidence", type=float, default=0.0)
    add("--show-secrets", action="store_true")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog=report.TOOL, description="Finds leaked credentials in logs.")
    commands = top.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan")
    _reading(scan)
    _selection(scan)
    scan.add_argument("--format", choices=("table", "json", "csv", "sarif"), default="table")
    scan.add_argument("--output")
    scan.add_argument("--baseline")
    scan.add_argument("--write-baseline")
    scan.add_argument("--fail-on", choices=(*SEVERITIES, "none"), default="high")
    scan.add_argument("--stats", action="store_true", help="adds lines, bytes, time, throughput, and how many candidates were rejected, and why")
    scan.add_argument("--max-findings", type=int, default=Options.max_findings_per_source, help="of a source; the report says which sources had more")
    scan.add_argument("--verbose", action="store_true", help="the evidence of each finding, too")
    scan.add_argument("--quiet", action="store_true", help="one line for each finding, without a heading")
    masked = commands.add_parser("redact")
    _reading(masked)
    _selection(masked)
    masked.add_argument("--output-dir", required=True)
    masked.add_argument("--force", action="store_true")
    for name in ("rules-list", "rules-show", "rules-validate"):
        some = commands.add_parser(name)
        if name == "rules-show":
            some.add_argument("rule_id")
        if name == "rules-list":
            some.add_argument("--show-pattern", action="store_true")
            some.add_argument("--write", help="a folder for Markdown pages of the rules")
        _selection(some)
    tested = commands.add_parser("selftest")
    tested.add_argument("--verbose", action="store_true")
    timed = commands.add_parser("benchmark")
    timed.add_argument("--size", type=parse_size, default=parse_size("256MB"))
    timed.add_argument("--secret-ratio", type=float, default=SECRET_SHARE)
    timed.add_argument("--keep", help="a folder in which the made-up log stays")
    timed.add_argument("--decode-base64", action="store_true")
    commands.add_parser("version")
    return top


def rules_of(given: argparse.Namespace) -> RuleSet:
    loaded = load_rules(given.rules, not given.no_builtin_rules)
    chosen = loaded.select(given.include_rule, given.exclude_rule, given.enable_rule, given.pack, given.tag, given.min_severity, given.aggressive).with_min_entropy(given.min_entropy)
    if not chosen.rules:
        raise RuleError("no rule is left")
    return chosen


def options_of(given: argparse.Namespace) -> Options:
    return Options(structured=not given.no_structured, nested_json=not given.no_nested_json, decode_base64=given.decode_base64, max_line_bytes=given.max_line_bytes, min_confidence=given.min_confidence, max_findings_per_source=getattr(given, "max_findings", Options.max_findings_per_source))


def session() -> SparkSession:
    return SparkSession.builder.appName(report.TOOL).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _spooled(paths: list[str], folder: Path) -> list[str]:
    """Standard input as a file, for it can be read only once and only here."""
    out = []
    for path in paths:
        if source_kind(path) == "stream":
            path = str(folder / "stdin.log")
            Path(path).write_bytes(sys.stdin.buffer.read())
        out.append(path)
    return out


def run_scan(given: argparse.Namespace) -> int:
    import tempfile

    spark = session()
    with tempfile.TemporaryDirectory() as folder:
        paths, errors = readable(_spooled(resolve_inputs(given.paths, not given.no_recursive, all_files=given.all_files), Path(folder)))
        began = time.monotonic()
        options = options_of(given)
        lines, rules = read_lines(spark, paths), rules_of(given)
        tried = candidates(read_lines(spark, paths, screen_of(rules, options)), rules, options).cache()
        every = findings(tried, options).cache()
        truncated = truncated_sources(every, options.max_findings_per_source)
        found = groups.group_findings(capped(every, options.max_findings_per_source)).cache()
        hidden = 0
        if given.baseline:
            known = groups.read_baseline(spark, given.baseline)
            hidden = groups.known_groups(found, known).count()
            found = groups.new_groups(found, known).cache()
        if given.write_baseline:
            groups.write_baseline(found, given.write_baseline)
        stats = {"suppressed_by_baseline": hidden, "truncated": bool(truncated), "truncated_sources": truncated}
        if given.stats:
            found.count()
            stats |= scan_stats(lines, len(paths), time.monotonic() - began)
            rejected = groups.noise_funnel(tried).where("outcome != 'accepted'").groupBy("reason").agg(F.sum("candidates").alias("n")).orderBy(F.desc("n"), "reason").limit(20)
            stats["rejected"] = {r["reason"]: r["n"] for r in rejected.collect()}
        if given.format == "table":
            shown = report.to_lines if given.quiet else report.to_details if given.verbose else report.to_table
            text = shown(found, show_secrets=given.show_secrets) + ("\n" + json.dumps(stats) if given.stats else "")
        elif given.format == "json":
            text = report.to_json(found, paths, errors, stats, given.show_secrets)
        elif given.format == "sarif":
            text = report.to_sarif(found, errors, given.show_secrets)
        else:
            text = report.export(found, given.format, with_secret=given.show_secrets)
        for error in errors:
            print(f"error: {error}", file=sys.stderr)
        if truncated:
            print(f"only the first {options.max_findings_per_source} findings of {', '.join(truncated)}", file=sys.stderr)
        if given.output:
            Path(given.output).write_text(text, encoding="utf-8")
        else:
            print(text)
        return FAILED if errors else FOUND if groups.fails(found, given.fail_on) else CLEAN


def readable(paths: list[str]) -> tuple[list[str], list[str]]:
    """The local files that open, and what is wrong with the others; paths in other stores are left to Spark."""
    good, errors = [], []
    for path in paths:
        try:
            if "://" not in path:
                with open(path, "rb"):
                    pass
            good.append(path)
        except OSError as e:
            errors.append(f"{path}: {e.strerror or e}")
    return good, errors


def scan_stats(lines: DataFrame, files: int, seconds: float) -> dict:
    """Lines, bytes, time, throughput and the driver's peak memory of a scan."""
    row = lines.agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(F.octet_length("line").cast("long") + 1), F.lit(0)).alias("bytes")).first()
    return {"files": files, "lines": row["lines"], "bytes_scanned": row["bytes"], "elapsed_seconds": round(seconds, 4), "throughput_mib_per_second": round(row["bytes"] / 2**20 / max(seconds, 1e-9), 2), "peak_rss_main": peak_memory()}


def run_selftest(given: argparse.Namespace) -> int:
    """All rules, the noisy ones too, on a sample each, and on lines without a secret."""
    missed, wrong = selftest(session(), load_rules().select(enable_all=True))
    print(f"found {len(positives()) - len(missed)}/{len(positives())}, clean {len(NEGATIVES) - len(wrong)}/{len(NEGATIVES)}")
    for name in missed:
        print(f"missed: {name}")
    for text in wrong:
        print(f"not clean: {text}")
    if given.verbose:
        print("\n".join(name for name in positives() if name not in missed))
    return FOUND if missed or wrong else CLEAN


def run_benchmark(given: argparse.Namespace) -> int:
    """Writes a made-up log, and times a scan of it by the default rules."""
    import tempfile

    spark = session()
    with tempfile.TemporaryDirectory() as folder:
        path = f"{given.keep or folder}/made-up"
        made_up_log(spark, given.size, given.secret_ratio).select("line").write.mode("overwrite").text(path)
        lines = read_lines(spark, resolve_inputs([path], suffixes=(".txt",)))
        began = time.monotonic()
        rules, options = load_rules(), Options(decode_base64=given.decode_base64)
        tried = candidates(read_lines(spark, resolve_inputs([path], suffixes=(".txt",)), screen_of(rules, options)), rules, options).cache()
        found = groups.group_findings(findings(tried))
        groups_found, hits = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("occurrences"), F.lit(0))).first()
        stats = scan_stats(lines, 1, time.monotonic() - began)
        print(f"{stats['throughput_mib_per_second']} MiB/s, {stats['elapsed_seconds']} s, {format_bytes(stats['bytes_scanned'])}, {stats['lines']} lines, driver's peak {format_bytes(stats['peak_rss_main'])}")
        print(f"{groups_found} different secrets, {hits} times; {tried.count()} candidates")
    return CLEAN


def run_redact(given: argparse.Namespace) -> int:
    spark = session()
    paths = resolve_inputs(given.paths, not given.no_recursive, all_files=given.all_files)
    folder = Path(given.output_dir)
    targets = [folder / Path(p).name for p in paths]
    if any(source_kind(p) != "seekable" for p in paths):
        raise ValueError("only plain files can be redacted")
    if folder.exists() and not folder.is_dir():
        raise ValueError(f"{folder} is not a folder")
    if len(set(targets)) < len(targets):
        raise ValueError("two inputs have the same name")
    if {t.resolve() for t in targets} & {Path(p).resolve() for p in paths}:
        raise ValueError("an input would be overwritten")
    if not given.force and any(t.exists() for t in targets):
        raise ValueError("an output exists; --force replaces it")
    options = options_of(given)
    rules = rules_of(given)
    found = groups.group_findings(findings(candidates(read_lines(spark, paths, screen_of(rules, options)), rules, options), options)).cache()
    by_source = {r["source"]: list(r["secrets"]) for r in redact.secrets_by_source(found).toLocalIterator()}
    folder.mkdir(parents=True, exist_ok=True)
    for path, target in zip(paths, targets, strict=True):
        pairs = redact.replacements(by_source.get(str(Path(path).resolve()), by_source.get(path, [])))
        print(f"{target}: {redact.redact_file(path, target, pairs)} replaced")
    return CLEAN


def main(arguments: list[str] | None = None) -> int:
    given = parser().parse_args(arguments)
    try:
        if given.command == "version":
            print(f"{report.TOOL} {report.VERSION}")
        elif given.command == "scan":
            return run_scan(given)
        elif given.command in ("redact", "selftest", "benchmark"):
            return {"redact": run_redact, "selftest": run_selftest, "benchmark": run_benchmark}[given.command](given)
        elif given.command == "rules-show":
            print(json.dumps(rules_of(given).get(given.rule_id).to_mapping(), indent=2))
        else:
            chosen = rules_of(given)
            for r in chosen.rules:
                print(f"{r.id}  {r.severity}  {r.pack}  {'entropy' if r.gate.enabled else 'shape'}  {'on' if r.enabled else 'off'}  {r.name}" + (f"  {r.pattern}" if getattr(given, "show_pattern", False) else ""))
            for name, page in report.rule_catalogue(chosen).items() if getattr(given, "write", None) else ():
                Path(given.write).mkdir(parents=True, exist_ok=True)
                Path(given.write, name).write_text(page, encoding="utf-8")
            print(f"{len(chosen.rules)} rules, {len(chosen.enabled)} on, all valid")
    except (ValueError, FileNotFoundError, StopIteration) as e:
        print(f"error: {e or 'there is no such rule'}", file=sys.stderr)
        return FAILED
    return CLEAN


if __name__ == "__main__":
    sys.exit(main())
