"""Reports of grouped findings: JSON, CSV, SARIF and plain tables; the catalogue of rules."""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import SAMPLES, context_summary, ordered
from .rules import SEVERITIES, RuleSet

TOOL, VERSION = "glintsieve", "0.1.0"
# The columns of a CSV report, and the level of each severity in SARIF.
CSV_COLUMNS = (
    "fingerprint rule_id rule_name severity confidence confidence_score occurrences source line column byte_offset json_path secret_masked secret_length "
    "entropy normalized_entropy charset encoding cloud_schema cloud_actor cloud_action cloud_region cloud_source_ip cloud_timestamp context_summary evidence tags"
).split()
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
#: Rows of a table on the console.
CONSOLE_ROWS = 200


def payload(groups: DataFrame, with_secret: bool = False) -> DataFrame:
    """A row for each group with the names and figures that reports use."""
    names: dict[str, Column] = {
        "fingerprint": F.col("fingerprint"), "rule_id": F.col("rule_id"), "rule_name": F.col("rule_name"), "severity": F.col("severity"), "confidence": F.col("confidence"),
        "confidence_score": F.round("score", 4), "source": F.col("source"), "line": F.col("line_no"), "column": F.col("column"), "byte_offset": F.col("byte_offset"), "json_path": F.col("json_path"),
        "secret_masked": F.col("secret_masked"), "secret_length": F.length("secret"), "entropy": F.round("entropy", 4), "normalized_entropy": F.round("normalized", 4), "charset": F.col("charset"),
        "evidence": F.col("evidence"), "cloud_context": F.col("context"), "context_summary": context_summary(), "tags": F.col("tags"),
        "occurrences": F.col("occurrences"), "sources": F.col("sources"), "json_paths": F.col("json_paths"), "sample_locations": F.slice("sample_locations", 1, SAMPLES),
    }
    if with_secret:
        names["secret"] = F.col("secret")
    return groups.select(*[c.alias(n) for n, c in names.items()], F.col("severity_rank").alias("_rank"))


def csv_frame(groups: DataFrame, with_secret: bool = False) -> DataFrame:
    """The CSV report's columns, all text or figures, for ``write.csv``."""
    rows = payload(groups, with_secret)
    of = lambda name: F.coalesce(F.col("cloud_context")[name], F.lit(""))
    flat = {"json_path": F.coalesce("json_path", F.lit("")), "encoding": of("encoding"), "evidence": F.array_join("evidence", "; "), "tags": F.array_join("tags", ",")}
    flat |= {f"cloud_{n}": of(n) for n in ("schema", "actor", "action", "region", "source_ip", "timestamp")}
    return rows.withColumns(flat).select(*CSV_COLUMNS, *(["secret"] if with_secret else []))


def _rows(groups: DataFrame, with_secret: bool) -> list[dict]:
    rows = [r.asDict(recursive=True) for r in payload(ordered(groups), with_secret).drop("_rank").collect()]
    return rows


def to_json(groups: DataFrame, sources: list[str] = (), errors: list[str] = (), stats: dict | None = None, with_secret: bool = False) -> str:
    """The JSON report; a report is of groups, which are as many as there are different secrets."""
    rows = _rows(groups, with_secret)
    by = {s: n for s in SEVERITIES if (n := sum(r["severity"] == s for r in rows))}
    return _dumped(_json_report(rows, len(rows), sum(r["occurrences"] for r in rows), by, sources, errors, stats))


def _dumped(what: dict) -> str:
    return json.dumps(what, indent=2, ensure_ascii=False)


def _json_report(rows: list, count: int, occurrences: int, by: dict[str, int], sources: list[str] = (), errors: list[str] = (), stats: dict | None = None) -> dict:
    summary = {"findings": count, "occurrences": occurrences, "by_severity": by, "sources": list(sources), "errors": list(errors)}
    return {"tool": {"name": TOOL, "version": VERSION}, "summary": summary, "stats": stats or {}, "findings": rows}


def to_csv(groups: DataFrame, with_secret: bool = False) -> str:
    out = io.StringIO(newline="")
    frame = csv_frame(ordered(groups), with_secret)
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(frame.columns)
    writer.writerows(tuple(r) for r in frame.toLocalIterator())
    return out.getvalue()


def to_sarif(groups: DataFrame, errors: list[str] = (), with_secret: bool = False) -> str:
    """A SARIF 2.1.0 document: a rule for each that is found, in order of appearance, and a result for each group."""
    rows = _rows(groups, with_secret)
    rules = {}
    for r in rows:
        rules.setdefault(r["rule_id"], _sarif_rule(r))
    return _dumped(_sarif_report(list(rules.values()), [_sarif_result(r, with_secret) for r in rows], errors))


def _sarif_rule(r: dict) -> dict:
    named = {"text": r["rule_name"]}
    return {"id": r["rule_id"], "name": r["rule_name"], "shortDescription": named, "fullDescription": named, "defaultConfiguration": {"level": SARIF_LEVEL[r["severity"]]}, "properties": {"tags": r["tags"] or ["security"], "severity": r["severity"]}}


def _sarif_result(r: dict, with_secret: bool) -> dict:
    shown = f"secret={r['secret']}" if with_secret else f"masked={r['secret_masked']}"
    place = {
        "physicalLocation": {"artifactLocation": {"uri": r["source"].replace("\\", "/")}, "region": {"startLine": max(1, r["line"]), "startColumn": max(1, r["column"] or 1)}},
        "logicalLocations": [{"name": r["json_path"], "kind": "member"}] if r["json_path"] else [],
    }
    known = {"confidence": r["confidence"], "confidenceScore": r["confidence_score"], "entropy": r["entropy"], "normalizedEntropy": r["normalized_entropy"], "charset": r["charset"], "occurrences": r["occurrences"], "evidence": r["evidence"], "cloudContext": r["cloud_context"]}
    return {"ruleId": r["rule_id"], "level": SARIF_LEVEL[r["severity"]], "message": {"text": f"{r['rule_name']}: {r['context_summary']} ({shown})"}, "partialFingerprints": {f"{TOOL}/v1": r["fingerprint"]}, "locations": [place], "properties": known}


def _sarif_report(rules: list, results: list, errors: list[str] = ()) -> dict:
    told = [{"level": "error", "message": {"text": e}} for e in errors]
    run = {"tool": {"driver": {"name": TOOL, "version": VERSION, "rules": rules}}, "results": results, "invocations": [{"executionSuccessful": not errors, "toolExecutionNotifications": told}]}
    return {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]}


def report_pieces(groups: DataFrame, with_secret: bool = False) -> DataFrame:
    """(part, sarif, json): both reports in pieces; joined in order of part they are what ``to_sarif`` and ``to_json`` give.

    The first and the last row are what comes before and after the groups, and each
    group between them is a row, made by the workers: the driver has a row for each rule.
    """
    spark = groups.sparkSession
    place = F.struct("severity_rank", (-F.col("score")).alias("score"), (-F.col("occurrences")).alias("occurrences"), "rule_id", "fingerprint")
    told = F.min_by(F.struct("rule_id", "rule_name", "severity", "tags"), place)
    # As few as there are rules.
    found = groups.groupBy("rule_id", "severity").agg(F.min(place).alias("first"), told.alias("told"), F.count(F.lit(1)).alias("n"), F.sum("occurrences").alias("occurrences")).collect()
    found.sort(key=lambda r: tuple(r["first"]))
    rules = {}
    for r in found:
        rules.setdefault(r["rule_id"], _sarif_rule(r["told"].asDict(recursive=True)))
    by = {s: n for s in SEVERITIES if (n := sum(r["n"] for r in found if r["severity"] == s))}
    mark = uuid.uuid4().hex
    some = [mark] if found else []
    whole = {"sarif": _sarif_report(list(rules.values()), some), "json": _json_report(some, sum(r["n"] for r in found), sum(r["occurrences"] for r in found), by)}
    around = {name: [*_dumped(what).split(f'"{mark}"'), ""][:2] for name, what in whole.items()}
    begin = {name: "\n" + before.rpartition("\n")[2] for name, (before, _) in around.items()}
    first = found[0]["first"]["fingerprint"] if found else None

    def piece(name: str, what: dict, comma: bool) -> str:
        return ("," + begin[name] if comma else "") + _dumped(what).replace("\n", begin[name])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            parts = [r.pop("part") for r in rows]
            for r in rows:
                r["cloud_context"] = None if r["cloud_context"] is None else dict(r["cloud_context"])
            more = [r["fingerprint"] != first for r in rows]
            sarif = [piece("sarif", _sarif_result(r, with_secret), comma) for r, comma in zip(rows, more, strict=True)]
            yield pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int64()), "sarif": pa.array(sarif, pa.string()), "json": pa.array([piece("json", r, comma) for r, comma in zip(rows, more, strict=True)], pa.string())})

    kinds = "part long, sarif string, json string"
    # Numbers grow along the order, from 0; one below and the largest long are before and after all.
    numbered = payload(ordered(groups), with_secret).drop("_rank").withColumn("part", F.monotonically_increasing_id())
    ends = [(part, around["sarif"][i], around["json"][i]) for i, part in enumerate((-1, 2**63 - 1))]
    return spark.createDataFrame(ends, kinds).unionByName(numbered.mapInArrow(write, kinds))


def export(groups: DataFrame, kind: str, **more) -> str:
    """A report as ``json``, ``csv`` or ``sarif``, in any case."""
    kinds = {"json": to_json, "csv": to_csv, "sarif": to_sarif}
    name = kind.strip().lower()
    if name not in kinds:
        raise ValueError(f"{kind!r} is none of {', '.join(kinds)}")
    return kinds[name](groups, **more)


def to_table(groups: DataFrame, rows: int = CONSOLE_ROWS, show_secrets: bool = False) -> str:
    """The first groups as aligned text; secrets stay masked unless asked for."""
    shown = payload(ordered(groups), True).limit(rows).collect()
    cells = [("severity", "rule", "secret", "times", "where")]
    cells += [(r["severity"], r["rule_id"], r["secret"] if show_secrets else r["secret_masked"], str(r["occurrences"]), r["context_summary"]) for r in shown]
    widths = [max(len(row[i]) for row in cells) for i in range(len(cells[0]))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() for row in cells)


def to_lines(groups: DataFrame, rows: int = CONSOLE_ROWS, show_secrets: bool = False) -> str:
    """A line for each of the first groups."""
    shown = payload(ordered(groups), True).limit(rows).collect()
    return "\n".join(f"{r['severity']} {r['rule_id']} {r['source']}:{r['line']}:{r['column']} {r['secret'] if show_secrets else r['secret_masked']}" for r in shown)


def to_details(groups: DataFrame, rows: int = CONSOLE_ROWS, show_secrets: bool = False) -> str:
    """The first groups with their evidence, context and further places."""
    out = []
    for r in payload(ordered(groups), True).limit(rows).collect():
        facts = {
            "where": r["context_summary"], "secret": r["secret"] if show_secrets else r["secret_masked"], "confidence": f"{r['confidence']} ({r['confidence_score']})",
            "entropy": f"{r['entropy']} ({r['charset']})", "evidence": "; ".join(r["evidence"]), "context": ", ".join(f"{k}={v}" for k, v in sorted((r["cloud_context"] or {}).items()) if v),
            "times": str(r["occurrences"]), "also at": ", ".join(r["sample_locations"]), "fingerprint": r["fingerprint"],
        }
        out.append("\n".join([f"{r['severity']}: {r['rule_name']} ({r['rule_id']})", *(f"  {k:<12}{v}" for k, v in facts.items() if v)]))
    return "\n\n".join(out)


def rule_catalogue(rules: RuleSet) -> dict[str, str]:
    """Markdown pages: an index, and one for each pack with its rules by id."""
    escaped = lambda text: str(text).replace("|", "\\|")
    pages = {"index.md": "# Rules\n\n| pack | rules |\n|-|-|\n" + "".join(f"| [{p}]({p}.md) | {sum(r.pack == p for r in rules.rules)} |\n" for p in rules.packs)}
    for pack in rules.packs:
        lines = [f"# {pack}\n", "| id | severity | confidence | gate | on | name |", "|-|-|-|-|-|-|"]
        for r in sorted((r for r in rules.rules if r.pack == pack), key=lambda r: r.id):
            lines.append("| " + " | ".join(map(escaped, (r.id, r.severity, r.confidence, "entropy" if r.gate.enabled else "shape", "yes" if r.enabled else "no", r.name))) + " |")
        pages[f"{pack}.md"] = "\n".join(lines) + "\n"
    return pages
