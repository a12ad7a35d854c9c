"""Findings grouped by fingerprint, the baseline, the noise funnel and totals."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rules import SEVERITIES, severity_rank

#: Locators of a group besides its representative.
SAMPLES = 5
#: A group's findings are ranked in so many parts first, so that one secret in a third of all lines is spread.
SALTS = 32
BASELINE_VERSION = 1
#: Columns that order findings as a serial scan meets them.
ORDER = ["source", "line_no", "ord"]


def locator(prefix: str = "") -> Column:
    c = lambda name: F.col(f"{prefix}{name}")
    base = F.concat(c("source"), F.lit(":"), c("line_no").cast("string"))
    return F.when(F.length(c("json_path")) > 0, F.concat(base, F.lit(" → "), c("json_path"))).when(c("column") > 0, F.concat(base, F.lit(":"), c("column").cast("string"))).otherwise(base)


def context_summary() -> Column:
    """Actor, action (or else resource) and path; the locator if none is known."""
    some = lambda c: F.when(F.length(c) > 0, c)
    action, resource = some(F.col("context")["action"]), some(F.col("context")["resource"])
    parts = F.concat_ws(" → ", some(F.col("context")["actor"]), F.concat(F.lit("action: "), action), F.when(action.isNull(), F.concat(F.lit("resource: "), resource)), some(F.col("json_path")))
    return F.when(parts != "", parts).otherwise(locator())


def group_findings(found: DataFrame) -> DataFrame:
    """One row for each fingerprint: its representative's columns and what its findings add up to.

    The representative has the largest score, the first of several in order of source,
    line and place.  Added are occurrences, sources, json_paths and sample_locations:
    the first locators of the other findings.
    """
    score = F.struct((-F.col("score")).alias("s"), *ORDER)
    # One shuffle of the findings, in salted parts, gives all; a fingerprint's parts are then few rows.
    spread = found.select(
        "fingerprint", "source", "json_path", F.pmod(F.xxhash64("source", "line_no"), F.lit(SALTS)).alias("_salt"),
        score.alias("_score"), F.struct(*found.columns).alias("_row"), F.struct(*ORDER, locator().alias("place")).alias("_place"),
    )
    nth = F.row_number().over(Window.partitionBy("fingerprint", "_salt").orderBy("_place"))
    parts = spread.withColumn("_nth", nth).groupBy("fingerprint", "_salt").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("_row", "_score").alias("best"), F.min("_score").alias("score"),
        F.collect_set("source").alias("sources"), F.collect_set(F.when(F.length("json_path") > 0, F.col("json_path"))).alias("json_paths"),
        F.collect_list(F.when(F.col("_nth") <= SAMPLES + 1, F.col("_place"))).alias("places"),
    )
    whole = parts.groupBy("fingerprint").agg(
        F.sum("n").alias("occurrences"), F.min_by("best", "score").alias("best"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("json_paths")))).alias("json_paths"),
        F.array_sort(F.flatten(F.collect_list("places"))).alias("places"),
    )
    # The representative may be among the first places, and is no sample of itself.
    itself = F.array_position(F.transform("places", lambda x: F.struct(*[x[c].alias(c) for c in ORDER])), F.struct(*[F.col("best")[c].alias(c) for c in ORDER]))
    others = F.filter("places", lambda x, i: i + 1 != itself)
    return whole.select("best.*", "occurrences", "sources", "json_paths", F.transform(F.slice(others, 1, SAMPLES), lambda x: x["place"]).alias("sample_locations"))


def ordered(groups: DataFrame) -> DataFrame:
    """Groups as reports list them: worst, surest, most frequent first."""
    return groups.orderBy("severity_rank", F.desc("score"), F.desc("occurrences"), "rule_id", "fingerprint")


def count_by_severity(groups: DataFrame) -> DataFrame:
    return groups.groupBy("severity", "severity_rank").agg(F.count(F.lit(1)).alias("findings"), F.sum("occurrences").cast("long").alias("occurrences"))


def worst_severity(groups: DataFrame) -> str | None:
    rank = groups.agg(F.min("severity_rank")).first()[0]
    return None if rank is None else SEVERITIES[rank]


def fails(groups: DataFrame, severity: str) -> bool:
    """Whether some group is as bad as ``severity``; never for ``none``."""
    return severity != "none" and not groups.where(F.col("severity_rank") <= severity_rank(severity)).isEmpty()


def noise_funnel(found: DataFrame) -> DataFrame:
    """(rule_id, outcome, reason, candidates) of all candidates that were looked at; a reason without its figures."""
    looked = found.where("outcome != 'beyond-cap'")
    return looked.groupBy("rule_id", "outcome", F.regexp_replace(F.coalesce("reason", F.lit("")), r"\(.*", "").alias("reason")).agg(F.count(F.lit(1)).alias("candidates"))


def baseline_of(groups: DataFrame, note: str = "") -> dict:
    """A baseline of groups: fingerprints and where each was seen, no secrets."""
    rows = groups.select("fingerprint", "rule_id", "severity", locator().alias("location"), "secret_masked", "occurrences").toLocalIterator()
    entries = {r["fingerprint"]: {k: r[k] for k in ("rule_id", "severity", "location", "secret_masked", "occurrences")} for r in rows}
    return {"version": BASELINE_VERSION, "generated_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "note": note, "fingerprints": sorted(entries), "entries": entries}


def write_baseline(groups: DataFrame, path: str | Path, note: str = "") -> None:
    Path(path).write_text(json.dumps(baseline_of(groups, note), indent=2, ensure_ascii=False), encoding="utf-8")


def read_baseline(spark: SparkSession, path: str | Path) -> DataFrame:
    """(fingerprint): those of a baseline file, from its list or else its entries."""
    try:
        given = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise ValueError(f"{path}: the baseline can't be read: {e}") from e
    if not isinstance(given, dict) or given.get("version", BASELINE_VERSION) != BASELINE_VERSION:
        raise ValueError(f"{path}: not a baseline of version {BASELINE_VERSION}")
    names = sorted(set(map(str, given.get("fingerprints") or given.get("entries") or ())))
    return spark.createDataFrame([(n,) for n in names], "fingerprint string")


def new_groups(groups: DataFrame, baseline: DataFrame) -> DataFrame:
    return groups.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def known_groups(groups: DataFrame, baseline: DataFrame) -> DataFrame:
    return groups.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_semi")
