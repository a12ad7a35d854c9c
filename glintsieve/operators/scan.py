"""From lines to candidates and findings.

The screen runs first, in the JVM, and leaves few lines; only these go to the detector,
in Arrow batches.  Candidates are kept, rejected ones too, with the reason: they are
what the noise funnel counts.  Of the accepted ones those that overlap are collapsed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gate as gates
from ..functions import scalar
from .detect import Candidate, Detector, Options
from .rules import CONFIDENCE_FROM, CONFIDENCES, RuleSet, severity_rank
from .screen import screen_pattern

_CANDIDATE = "rule_ord int, scope int, nth int, secret string, column int, excluded boolean, keyword_near boolean, structured boolean, encoding string, json_path string, snippet string"
_FIELDS = list(Candidate.__dataclass_fields__)


def screen_of(rules: RuleSet, options: Options | None = None) -> Column:
    """The condition on line that is true wherever some enabled rule may match."""
    options = options or Options()
    on = [r for r in rules.enabled if options.structured or not r.json_keys]
    pattern = screen_pattern(on, options.decode_base64)
    if not on:
        return F.lit(False)
    return F.lower("line").rlike(pattern) if pattern else F.col("line") != ""


def screened(lines: DataFrame, rules: RuleSet, options: Options | None = None) -> DataFrame:
    """The lines that some enabled rule may match."""
    return lines.where(screen_of(rules, options))


def rule_table(lines: DataFrame, rules: RuleSet) -> DataFrame:
    """What candidates get from their rule, a row for each rule; it is as small as the rule files."""
    gate_kinds = "enabled boolean, min_entropy double, min_normalized double, min_length int, max_length int, min_charset_coverage double, max_repeat_run int, max_sequential_run int, max_word_likeness double, reject_encoded_text boolean, reject_placeholders boolean, reject_uuid boolean, charsets array<string>"
    kinds = "rule_ord int, rule_id string, rule_name string, pack string, severity string, severity_rank int, tags array<string>, _base double, _required boolean, _gate struct<" + gate_kinds.replace(", ", ",").replace(" ", ":") + ">"
    rows = [(i, r.id, r.name, r.pack, r.severity, severity_rank(r.severity), list(r.tags), CONFIDENCES[r.confidence], r.require_keyword, r.gate.as_row()) for i, r in enumerate(rules.rules)]
    return lines.sparkSession.createDataFrame(rows, kinds)


def candidates(lines: DataFrame, rules: RuleSet, options: Options | None = None) -> DataFrame:
    """Every candidate on ``lines`` (source, line_no, byte_offset, line; raw binary if there is), with its verdict.

    ``outcome`` is accepted, keyword, entropy, confidence or beyond-cap (a rule's matches
    after its first accepted ones on a line, leaf or token, which are not looked at).
    Null lines have no candidates.
    """
    options = options or Options()
    plain = Options(**{**options.__dict__})

    @F.pandas_udf(f"context map<string,string>, found array<struct<{_CANDIDATE.replace(' ', ':').replace(',:', ',')}>>")
    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        detector = Detector(rules, plain)
        for batch in batches:
            rows = []
            for line in batch:
                found, context = detector.scan(line if isinstance(line, bytes) else line.encode("utf-8", "surrogatepass"))
                rows.append((context, [dict(zip(_FIELDS, astuple(c), strict=True)) for c in found]))
            yield pd.DataFrame(rows, columns=["context", "found"])

    given = F.col("raw") if "raw" in lines.columns else F.col("line")
    hit = screened(lines.where("line is not null"), rules, options).withColumn("_d", detect(given))
    out = hit.select("source", "line_no", "byte_offset", "_d.context", F.posexplode("_d.found").alias("ord", "_c")).select("*", "_c.*").drop("_c")
    out = out.join(F.broadcast(rule_table(lines, rules)), "rule_ord")
    out = gates.judge(out, F.col("secret"), F.col("_gate")).withColumnRenamed("reason", "_why")
    bonus = F.when(F.col("keyword_near"), options.keyword_bonus).otherwise(0.0) + F.when(F.col("structured"), options.structured_bonus).otherwise(0.0)
    out = out.withColumn("score", F.round(F.least(F.greatest(F.col("_base") + F.col("delta") + bonus, F.lit(0.0)), F.lit(1.0)), 4))
    missing = F.col("_required") & ~F.col("keyword_near")
    weak = F.col("score") < options.min_confidence
    out = out.withColumn("outcome", F.when(F.col("excluded"), "entropy").when(missing, "keyword").when(F.col("_why").isNotNull(), "entropy").when(weak, "confidence").otherwise("accepted"))
    out = out.withColumn("reason", F.when(F.col("excluded"), "exclude-pattern").when(missing, "missing-required-keyword").when(F.col("_why").isNotNull(), F.col("_why")).when(weak, "below-min-confidence"))
    # A rule stops at its n-th accepted match on a line, leaf or token.
    earlier = Window.partitionBy("source", "line_no", "scope", "rule_ord").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col("outcome") == "accepted", 1).otherwise(0)).over(earlier), F.lit(0))
    out = out.repartition("source", "line_no").withColumn("outcome", F.when(before >= options.max_matches_per_rule, "beyond-cap").otherwise(F.col("outcome")))
    more = F.concat("evidence", *[F.when(F.col(c), F.array(F.lit(name))).otherwise(F.array().cast("array<string>")) for c, name in (("keyword_near", "keyword-nearby"), ("structured", "sensitive-json-key"))])
    own = F.create_map(F.lit("encoding"), F.col("encoding"))
    context = F.when(F.col("encoding").isNotNull(), F.map_concat(F.map_filter("context", lambda k, _: k != "encoding"), own)).otherwise(F.col("context"))
    return out.withColumns({"evidence": more, "context": context}).drop("_gate", "_base", "_required", "_why")


def _collapse(hits: Column) -> Column:
    """Greedy: in order of rank, a hit on the same path that overlaps a kept one becomes evidence of the first such."""

    def overlaps(kept: Column, hit: Column) -> Column:
        same_token = (kept["column"] == hit["column"]) & kept["encoding"].isNotNull() & hit["encoding"].isNull()
        return kept["json_path"].eqNullSafe(hit["json_path"]) & (F.contains(kept["secret"], hit["secret"]) | F.contains(hit["secret"], kept["secret"]) | same_token)

    def merge(state: Column, hit: Column) -> Column:
        first = F.array_position(F.transform(state, lambda k: overlaps(k, hit)), F.lit(True))
        told = F.array(F.concat(F.lit("also-matched:"), hit["rule_id"]))
        absorbed = F.transform(state, lambda k, i: F.when(i + 1 == first, k.withField("evidence", F.concat(k["evidence"], told))).otherwise(k))
        return F.when(first > 0, absorbed).otherwise(F.concat(state, F.array(hit)))

    return F.aggregate(hits, F.slice(hits, 1, 0), merge)


FINDING = ["source", "line_no", "byte_offset", "column", "rule_id", "rule_name", "pack", "severity", "severity_rank", "secret", "fingerprint", "secret_masked", "json_path", "encoding", "context", "entropy", "normalized", "charset", "evidence", "confidence", "score", "tags", "snippet", "ord"]


def findings(found: DataFrame, options: Options | None = None) -> DataFrame:
    """The accepted candidates as findings, overlaps collapsed; ``ord`` is the order within the line."""
    options = options or Options()
    confidence = F.lit("low")
    for name, least in reversed(CONFIDENCE_FROM):
        confidence = F.when(F.col("score") >= least, name).otherwise(confidence)
    made = found.where("outcome = 'accepted'").withColumns({"fingerprint": scalar.fingerprint(F.col("rule_id"), F.col("secret")), "secret_masked": scalar.mask(F.col("secret")), "confidence": confidence})
    made = made.select(*FINDING)
    if not options.collapse_overlaps:
        return made
    rank = F.struct(F.when(F.col("encoding").isNotNull(), 0).otherwise(1).alias("k0"), F.col("severity_rank").alias("k1"), (-F.col("score")).alias("k2"), F.length("secret").alias("k3"), F.col("ord").alias("k4"))
    rows = made.withColumn("_r", F.struct(rank.alias("rank"), *[F.col(c) for c in FINDING if c not in ("source", "line_no", "context")]))
    # A map can't be sorted, and it is the same for all of a line but for the encoding.
    lined = rows.groupBy("source", "line_no").agg(F.array_sort(F.collect_list("_r")).alias("hits"), F.first(F.map_filter("context", lambda k, _: k != "encoding")).alias("_context"))
    kept = lined.select("source", "line_no", "_context", F.explode(_collapse(F.col("hits"))).alias("h")).select("source", "line_no", "_context", "h.*")
    own = F.when(F.col("encoding").isNotNull(), F.create_map(F.lit("encoding"), F.col("encoding")))
    return kept.withColumn("context", F.when(own.isNotNull(), F.map_concat("_context", own)).otherwise(F.col("_context"))).select(*FINDING)


def scan(lines: DataFrame, rules: RuleSet, options: Options | None = None) -> DataFrame:
    """Findings on ``lines``, at most so many of a source as the options say, the first in order."""
    options = options or Options()
    return capped(findings(candidates(lines, rules, options), options), options.max_findings_per_source)


def capped(found: DataFrame, most: int) -> DataFrame:
    """The first findings of each source; the cap is a feature that keeps reports readable."""
    order = Window.partitionBy("source").orderBy("line_no", "ord", "rule_id")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def truncated_sources(found: DataFrame, most: int) -> list[str]:
    """The sources with more findings than the cap lets through; they are as few as such files."""
    return [r["source"] for r in found.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).orderBy("source").select("source").collect()]
