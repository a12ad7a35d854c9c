"""One query for each capability, over whole tables, and the same in SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gate as gates
from ..functions import scalar
from ..functions.gate import Gate
from ..operators import groups, leaves, redact, report
from ..operators.detect import Options
from ..operators.rules import RuleSet, load_rules
from ..operators.samples import NEGATIVES, positives
from ..operators.scan import candidates, findings, scan, screened
from ..sources.containers import reassemble
from ..sources.lines import table_lines
from . import logs

TABLES = ("orders", "events", "customer", "documents", "benchmark")
#: Least partitions of a table's lines: the tables' files have one row group each.
LEAST_PARTITIONS = 8


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        table.createOrReplaceTempView(name)


def made(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    views(spark, sf_dir, *names)
    return spark.sql(sql).repartition(max(LEAST_PARTITIONS, spark.sparkContext.defaultParallelism))


def app_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, logs.APP_LINES, "orders")


def cloud_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, logs.CLOUD_LINES, "events")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition(max(LEAST_PARTITIONS, spark.sparkContext.defaultParallelism))
    return table_lines(docs, F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.col("text"))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "customer")
    return spark.sql(logs.VALUES)


def only(*ids: str) -> RuleSet:
    return load_rules().select(include=ids)


STRUCTURAL = ("aws-access-key-id", "github-personal-access-token", "mailgun-api-key", "twilio-account-sid")


def found_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding: the cap of a source is for reports of the command line."""
    return findings(candidates(app_lines(spark, sf_dir), only(*STRUCTURAL)))


def grouped_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.group_findings(found_structural(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all findings of the default rules on application and cloud logs, as a CSV report has them."""
    lines = app_lines(spark, sf_dir).unionByName(cloud_lines(spark, sf_dir))
    return report.csv_frame(groups.group_findings(scan(lines, load_rules())))


def scan_lines(spark, sf_dir):
    return document_lines(spark, sf_dir).select("source", "line_no", "line")


def line_offsets(spark, sf_dir):
    return document_lines(spark, sf_dir).select("source", "line_no", "byte_offset")


def entropy_profile(spark, sf_dir):
    v = F.col("value")
    cs = scalar.detect_charset(v)
    return values(spark, sf_dir).select("id", F.round(scalar.shannon_entropy(v), 6).alias("entropy"), F.round(scalar.unique_ratio(v), 6).alias("unique_ratio"), F.round(scalar.charset_coverage(v, cs), 6).alias("coverage"))


def charset_distribution(spark, sf_dir):
    return values(spark, sf_dir).groupBy(scalar.detect_charset(F.col("value")).alias("charset")).agg(F.count(F.lit(1)).alias("n"))


def word_likeness(spark, sf_dir):
    return values(spark, sf_dir).select("id", scalar.word_likeness(F.col("value")).alias("word_likeness"))


def runs(spark, sf_dir):
    v = F.col("value")
    return values(spark, sf_dir).select("id", scalar.longest_repeat_run(v).cast("long").alias("repeat_run"), scalar.longest_sequential_run(v).cast("long").alias("sequential_run"))


def value_shapes(spark, sf_dir):
    v = F.col("value")
    return values(spark, sf_dir).select("id", scalar.has_placeholder(v).alias("placeholder"), v.rlike(scalar.UUID).alias("uuid"), v.rlike(scalar.TIMESTAMP).alias("timestamp"), v.rlike(scalar.NUMERIC).alias("numeric"))


def encoded_text(spark, sf_dir):
    coded = F.when(F.col("id") % 2 == 0, F.base64(F.concat(F.lit('{"user":"'), F.col("value"), F.lit('"}')).cast("binary"))).otherwise(F.base64(F.unhex(F.sha2(F.col("value"), 256))))
    return values(spark, sf_dir).select("id", scalar.looks_like_encoded_text(coded).alias("encoded_text"))


def masks(spark, sf_dir):
    v = F.col("value")
    return values(spark, sf_dir).select("id", scalar.mask(v).alias("masked"), scalar.fingerprint(F.lit("some-rule"), v).alias("fingerprint"))


def gate_verdicts(spark, sf_dir):
    judged = gates.judge(values(spark, sf_dir).withColumn("g", Gate().as_struct()), F.col("value"), F.col("g"))
    return judged.select("id", F.regexp_replace(F.coalesce("reason", F.lit("accepted")), r"\(.*", "").alias("verdict"))


def _records(lines: pd.Series) -> pd.DataFrame:
    rows = []
    for line in lines:
        record = leaves.parse(line or "")
        rows.append((leaves.detect_schema(record), leaves.cloud_context(record), [x._asdict() for x in leaves.string_leaves(record)]))
    return pd.DataFrame(rows, columns=["schema", "context", "leaves"])


def record_of(line: str) -> Column:
    """Schema, context and string leaves of a JSON line."""
    return F.pandas_udf(_records, "schema string, context map<string,string>, leaves array<struct<path:string,key:string,value:string>>")(line)


def json_leaves(spark, sf_dir):
    made = cloud_lines(spark, sf_dir).withColumn("_r", record_of("line"))
    return made.select(F.col("line_no").alias("event_id"), F.explode("_r.leaves").alias("l")).select("event_id", "l.path", "l.value")


def schema_counts(spark, sf_dir):
    return cloud_lines(spark, sf_dir).select(record_of("line").alias("_r")).groupBy(F.col("_r.schema").alias("schema")).agg(F.count(F.lit(1)).alias("n"))


def cloud_contexts(spark, sf_dir):
    made = cloud_lines(spark, sf_dir).withColumn("_r", record_of("line"))
    return made.select(F.col("line_no").alias("event_id"), F.col("_r.context")["actor"].alias("actor"), F.col("_r.context")["action"].alias("action"))


def keyed_rule_hits(spark, sf_dir):
    """Every finding: the cap of a source is for reports."""
    return findings(candidates(cloud_lines(spark, sf_dir), only("sensitive-json-key-value"))).select(F.col("line_no").alias("event_id"), "json_path", "secret")


def vendor_prefixes(spark, sf_dir):
    return found_structural(spark, sf_dir).select("source", "line_no", "rule_id", "secret", F.col("column").cast("long").alias("column"))


def keyword_required(spark, sf_dir):
    found = candidates(app_lines(spark, sf_dir), only("twilio-account-sid"))
    return found.groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("n"))


def database_uris(spark, sf_dir):
    """Every finding: the cap of a source is for reports of the command line."""
    return findings(candidates(app_lines(spark, sf_dir), only("db-connection-uri-password"))).select("line_no", "secret")


def document_secrets(spark, sf_dir):
    return scan(document_lines(spark, sf_dir), only("generic-secret-assignment")).where(F.col("secret").rlike(r"\A[0-9a-fA-F]{40}\z")).select("source", "line_no", "secret")


def noise_funnel(spark, sf_dir):
    return groups.noise_funnel(candidates(app_lines(spark, sf_dir), only(*STRUCTURAL, "generic-secret-assignment")))


def groups_by_fingerprint(spark, sf_dir):
    return grouped_structural(spark, sf_dir).select("fingerprint", "rule_id", "secret_masked", "line_no", "occurrences", F.array_join("sources", ",").alias("sources"))


def top_groups(spark, sf_dir):
    return groups.ordered(grouped_structural(spark, sf_dir)).limit(20).select("fingerprint", "occurrences")


def sample_locations(spark, sf_dir):
    return grouped_structural(spark, sf_dir).select("fingerprint", F.array_join("sample_locations", ",").alias("sample_locations"))


def severity_counts(spark, sf_dir):
    return groups.count_by_severity(grouped_structural(spark, sf_dir)).select("severity", "findings", "occurrences")


def _baseline(found: DataFrame) -> DataFrame:
    return found.where("rule_id = 'mailgun-api-key'").select("fingerprint")


def baseline_new(spark, sf_dir):
    found = grouped_structural(spark, sf_dir)
    return groups.new_groups(found, _baseline(found)).select("fingerprint", "rule_id")


def baseline_known(spark, sf_dir):
    found = grouped_structural(spark, sf_dir)
    return groups.known_groups(found, _baseline(found)).select("fingerprint", "rule_id")


def per_source_cap(spark, sf_dir):
    found = scan(app_lines(spark, sf_dir), only("github-personal-access-token"), Options(max_findings_per_source=5))
    return found.select("source", "line_no")


def match_cap(spark, sf_dir):
    lines = app_lines(spark, sf_dir).where(F.col("line").contains("AKIA")).withColumn("line", F.regexp_replace(F.repeat(F.concat("line", F.lit(" ")), 10), "INFO", ""))
    found = candidates(lines, only("aws-access-key-id"))
    return found.groupBy("source", "line_no").agg(F.sum(F.when(F.col("outcome") == "accepted", 1).otherwise(0)).cast("long").alias("accepted"))


def overlap_collapse(spark, sf_dir):
    lines = app_lines(spark, sf_dir).withColumn("line", F.concat(F.lit("authorization: bearer "), F.regexp_extract("line", "ghp_[a-z0-9]+", 0))).where("line like '%ghp%'")
    found = scan(lines, load_rules())
    return found.select("source", "line_no", "rule_id", F.array_join(F.filter("evidence", lambda e: e.startswith("also-matched")), ",").alias("absorbed"))


def base64_layer(spark, sf_dir):
    lines = app_lines(spark, sf_dir).where(F.col("line").contains(" ghp_")).withColumn("line", F.concat(F.lit("payload "), F.translate(F.base64(F.col("line").cast("binary")), "\r\n", "")))
    return scan(lines, only("github-personal-access-token"), Options(decode_base64=True)).select("source", "line_no", "secret", "encoding", F.col("column").cast("long").alias("column"))


def _redacted(spark, sf_dir):
    lines = app_lines(spark, sf_dir)
    return redact.redact_lines(lines, groups.group_findings(scan(lines, only("github-personal-access-token"))))


def redact_lines(spark, sf_dir):
    return _redacted(spark, sf_dir).select("source", "line_no", "line")


def redact_counts(spark, sf_dir):
    return _redacted(spark, sf_dir).groupBy("source").agg(F.sum("masked").alias("masked"))


def container_lines(spark, sf_dir):
    return reassemble(made(spark, sf_dir, logs.CONTAINER_LINES, "orders"))


def rule_packs(spark, sf_dir):
    rules = load_rules().to_frame(spark)
    return rules.groupBy("pack").agg(F.count(F.lit(1)).alias("rules"), F.sum(F.col("enabled").cast("long")).alias("enabled"))


def csv_report(spark, sf_dir):
    return report.csv_frame(grouped_structural(spark, sf_dir))


def sarif_report(spark, sf_dir):
    """Both reports in pieces by part, as there are as many results as different secrets."""
    return report.report_pieces(grouped_structural(spark, sf_dir))


def all_rules_groups(spark, sf_dir):
    return flagship(spark, sf_dir)


def screen_keeps_findings(spark, sf_dir):
    """Findings of all rules, the noisy ones too, found without the screen's help: it must lose none."""
    rules = load_rules().select(enable_all=True)
    lines = app_lines(spark, sf_dir)
    kept = screened(lines, rules).select("source", "line_no").distinct()
    return findings(candidates(lines, rules)).join(kept, ["source", "line_no"], "left_anti").groupBy("rule_id").agg(F.count(F.lit(1)).alias("lost"))


def rule_samples(spark, sf_dir):
    """The rule that is found on its sample, for every built-in rule; and nothing on the lines without a secret."""
    texts = [("sample", name, text) for name, text in positives().items()] + [("clean", str(i), t) for i, t in enumerate(NEGATIVES)]
    lines = spark.createDataFrame([(f"{kind}/{name}", 1, 0, text) for kind, name, text in texts], "source string, line_no long, byte_offset long, line string")
    found = scan(lines, load_rules().select(enable_all=True)).select("source", F.explode(F.concat(F.array("rule_id"), F.transform("evidence", lambda e: F.regexp_extract(e, r"\Aalso-matched:(.*)", 1)))).alias("rule_id"))
    return found.where(F.col("rule_id") == F.regexp_extract("source", r"/(.*)", 1)).groupBy("rule_id").agg(F.countDistinct("source").alias("samples")).unionByName(found.where("source like 'clean/%'").groupBy("rule_id").agg(F.count(F.lit(1)).alias("samples")))


def stream_scan(spark, sf_dir):
    """Groups of a stream over the order lines; the folders are in the warehouse, which all machines share."""
    from ..streaming.stream import scan_stream, stream_groups

    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/stream-{uuid.uuid4().hex}"
    app_lines(spark, sf_dir).write.parquet(f"{folder}/in")
    lines = spark.readStream.schema("source string, line_no long, byte_offset long, line string").parquet(f"{folder}/in")
    scan_stream(lines, only(*STRUCTURAL), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return stream_groups(spark, f"{folder}/out").select("fingerprint", "occurrences")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        scan_lines, line_offsets, entropy_profile, charset_distribution, word_likeness, runs, value_shapes, encoded_text, masks, gate_verdicts, json_leaves, schema_counts, cloud_contexts,
        keyed_rule_hits, vendor_prefixes, keyword_required, database_uris, document_secrets, noise_funnel, groups_by_fingerprint, top_groups, sample_locations, severity_counts, baseline_new, baseline_known,
        per_source_cap, match_cap, overlap_collapse, base64_layer, redact_lines, redact_counts, container_lines, rule_packs, csv_report, sarif_report, all_rules_groups, screen_keeps_findings, stream_scan, rule_samples,
    )
}
