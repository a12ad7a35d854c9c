import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from glintsieve.operators import groups, leaves, redact, report
from glintsieve.operators.detect import Detector, Options, decode_text
from glintsieve.operators.rules import Rule, RuleSet, load_rules
from glintsieve.operators.scan import candidates, findings, scan, screened

from samples import NEGATIVES, positives


def lines_of(spark, *texts, source="a.log"):
    return spark.createDataFrame([(source, i + 1, 0, t) for i, t in enumerate(texts)], "source string, line_no long, byte_offset long, line string")


def everything():
    return load_rules().select(enable_all=True)


@pytest.fixture(scope="module")
def found_samples(spark):
    samples = positives()
    assert set(samples) == {r.id for r in load_rules().rules}
    return samples, scan(lines_of(spark, *samples.values()), everything()).collect()


def test_every_rule_finds_its_sample(found_samples):
    samples, found = found_samples
    for n, rule_id in enumerate(samples, 1):
        mine = [r for r in found if r.line_no == n]
        named = {r.rule_id for r in mine} | {e.split(":", 1)[1] for r in mine for e in r.evidence if e.startswith("also-matched:")}
        assert rule_id in named, (rule_id, samples[rule_id], mine)


def test_negatives(spark):
    found = scan(lines_of(spark, *NEGATIVES, None, ""), load_rules()).collect()
    assert [(r.line_no, r.rule_id, r.secret) for r in found] == []


def test_screen_and_partitions_do_not_change_results(spark):
    lines = lines_of(spark, *positives().values(), *NEGATIVES)
    rules = everything()
    want = {tuple(map(str, r)) for r in scan(lines, rules).collect()}
    assert {tuple(map(str, r)) for r in scan(lines.repartition(7), rules).collect()} == want
    # A rule that can match anything switches the screen off.
    wide = RuleSet.of([*rules.rules, Rule("anything", "any", "(qqq[0-9]*|zzz*)?")])
    assert screened(lines, wide).count() == lines.count()
    assert {tuple(map(str, r)) for r in scan(lines, wide).where("rule_id != 'anything'").collect()} == want


def test_repeated_literal_and_two_on_a_line(spark):
    one, two = positives(1)["aws-access-key-id"].split()[1], positives(2)["aws-access-key-id"].split()[1]
    found = scan(lines_of(spark, f"AKIA? {one} and {two} and {one}"), load_rules()).orderBy("column").collect()
    assert [(r.secret, r.column) for r in found] == [(one, 7), (two, 32)]


def test_columns_are_bytes_and_latin_secrets_survive(spark):
    key = positives()["aws-access-key-id"].split()[1]
    row = scan(lines_of(spark, f"é {key}"), load_rules()).first()
    assert row.column == 4 and row.secret == key
    assert Detector(load_rules()).scan(b"\xff " + key.encode())[0][0].secret == key


def test_cap_and_confidence(spark):
    keys = " ".join(positives(i)["aws-access-key-id"].split()[1] for i in range(12))
    tried = candidates(lines_of(spark, keys), load_rules().select(include=["aws-access-key-id"]))
    assert {r.outcome: r["count"] for r in tried.groupBy("outcome").count().collect()} == {"accepted": 8, "beyond-cap": 4}
    weak = candidates(lines_of(spark, positives()["generic-secret-assignment"]), load_rules(), Options(min_confidence=0.99))
    assert {(r.outcome, r.reason) for r in weak.collect()} == {("confidence", "below-min-confidence")}
    found = scan(lines_of(spark, keys, keys), load_rules(), Options(max_findings_per_source=3))
    assert sorted(r.line_no for r in found.collect()) == [1, 1, 1]


def test_keywords(spark):
    sid = positives()["twilio-account-sid"].split()[1]
    rules = load_rules().select(include=["twilio-account-sid"])
    tried = candidates(lines_of(spark, f"TWILIO {sid}", f"nothing {sid}", f"twilio {'x' * 200} {sid}", f"auth_token {sid} twilio"), rules)
    assert {r.line_no: r.outcome for r in tried.collect()} == {1: "accepted", 3: "keyword", 4: "accepted"}
    assert "keyword-nearby" in tried.where("line_no = 1").first().evidence


def test_structured(spark):
    token = positives()["generic-high-entropy-token"].split()[1][:40]
    record = {"eventVersion": "1", "eventSource": "s3", "eventName": "Get", "userIdentity": {"type": "IAMUser", "userName": "al"}, "requestParameters": {"headers": [f"Authorization: Bearer {token}"], "body": json.dumps({"deep": {"api_key": token[::-1]}})}}
    found = scan(lines_of(spark, json.dumps(record), " " + json.dumps(record)), load_rules()).collect()
    assert {r.json_path for r in found} == {"requestParameters.headers[0]", "requestParameters.body.deep.api_key"}
    assert all(r.context["actor"] == "AWS IAM User (al)" and r.context["action"] == "Get" for r in found)
    off = scan(lines_of(spark, json.dumps(record)), load_rules(), Options(structured=False)).collect()
    assert all(r.json_path is None and not r.context for r in off)


def test_leaves():
    get = lambda x, **k: [(y.path, y.key, y.value) for y in leaves.string_leaves(x, **k)]
    assert get({"A": {"b": ["x", {"c": "y"}, ""]}, "n": 1}) == [("A.b[0]", "b", "x"), ("A.b[1].c", "c", "y")]
    assert get({"j": '{"k":"v"}'}) == [("j", "j", '{"k":"v"}'), ("j.k", "k", "v")]
    assert get({"j": '{"k":"v"}'}, nested=False) == [("j", "j", '{"k":"v"}')]
    assert len(get({f"k{i}": "v" for i in range(100)}, max_nodes=10)) == 9
    deep = {"x": "end"}
    for _ in range(30):
        deep = {"d": deep}
    assert get(deep, max_depth=5) == [] and get(["a"]) == [("[0]", "", "a")] and get("a") == []
    assert leaves.parse("[1] x") is None and leaves.parse('{"a": NaN}') is None and leaves.parse("3") is None


def test_contexts():
    context = leaves.cloud_context
    assert context({"eventVersion": 1, "eventSource": "x", "userIdentity": {"arn": "arn:aws:iam::1:user/alice"}, "errorCode": "E"}) == {"schema": "aws-cloudtrail", "actor": "AWS Principal (alice)", "service": "x", "outcome": "error: E"}
    assert context({"userIdentity": {"type": "AssumedRole", "principalId": "AB:sess"}, "eventTime": "t"})["actor"] == "AWS Assumed Role (sess)"
    assert context({"protoPayload": {"methodName": "m"}, "insertId": 5}) == {"schema": "gcp-cloud-logging", "action": "m", "request_id": "5"}
    assert context({"apiVersion": "audit.k8s.io/v1", "verb": "get", "objectRef": {"resource": "pods", "namespace": "n", "name": "p"}, "sourceIPs": ["1.2.3.4"], "responseStatus": {"code": 200}}) == {"schema": "kubernetes-audit", "action": "get pods", "resource": "n/p", "source_ip": "1.2.3.4", "outcome": "200"}
    assert context({"operationName": "o", "resourceId": "r", "identity": {"claims": {"upn": "u"}}})["actor"] == "Azure Identity (u)"
    assert context({"@timestamp": "t", "event": {}, "user": {"id": True}}) == {"schema": "elastic-common-schema", "actor": "User (true)", "timestamp": "t"}
    assert context({"mdc": {"tenant": "t"}, "level": "INFO", "thread_name": "main"}) == {"schema": "jvm-json-log", "actor": "MDC user (t)", "severity": "INFO", "thread": "main"}
    assert context({"user": " x ", "path": "y" * 500})["resource"] == "y" * 160
    assert context([1]) == {} and leaves.detect_schema(3) == "unknown"
    for record in ({"userIdentity": 3, "eventName": 1}, {"logName": {}, "resource": 1}, {"kind": "Event", "verb": [], "user": 1}):
        assert context(record)["schema"]


def test_base64_layer(spark):
    key = positives()["github-personal-access-token"]
    token = base64.urlsafe_b64encode(f"user=me {key} end".encode()).decode().rstrip("=")
    line = json.dumps({"payload": token})
    assert scan(lines_of(spark, line), load_rules()).collect() == []
    row = scan(lines_of(spark, line), load_rules(), Options(decode_base64=True)).first()
    assert (row.secret, row.encoding, row.json_path, row.context["encoding"], row.column) == (key, "base64", "payload", "base64", line.index(token) + 1)
    assert decode_text(b"aGVsbG8gd29ybGQ", 5) is None and decode_text(b"aGVsbG8gd29ybGQ", 100) == b"hello world"
    assert decode_text(base64.b64encode(bytes(range(128, 160))), 100) is None and decode_text(b"abcde", 9) is None


def test_collapse(spark):
    token = positives()["openai-api-key"].split()[0]
    found = scan(lines_of(spark, f"Authorization: Bearer {token}"), load_rules()).collect()
    assert [r.rule_id for r in found] == ["openai-api-key"]
    assert "also-matched:authorization-header-bearer" in found[0].evidence
    apart = scan(lines_of(spark, f"Authorization: Bearer {token}"), load_rules(), Options(collapse_overlaps=False)).collect()
    assert {r.rule_id for r in apart} >= {"openai-api-key", "authorization-header-bearer"}


def test_long_lines(spark):
    key = positives()["aws-access-key-id"].split()[1]
    text = "password " * 40_000 + key
    assert scan(lines_of(spark, text), load_rules(), Options(max_line_bytes=1000)).collect() == []
    assert scan(lines_of(spark, text), load_rules(), Options(max_line_bytes=10**6)).first().secret == key


@pytest.fixture(scope="module")
def grouped(spark):
    draw = random.Random(2)
    a, b = positives(3)["github-personal-access-token"], positives(4)["mailgun-api-key"]
    lines = [f"n{i} {a if i % 3 else b}" for i in range(30)]
    some = lines_of(spark, *lines).unionByName(lines_of(spark, *lines[:4], source="b.log"))
    found = scan(some, load_rules())
    return a, b, some, groups.group_findings(found).cache(), draw


def test_groups(grouped, spark, tmp_path):
    a, b, _, found, _ = grouped
    rows = {r.secret: r for r in found.collect()}
    assert {s: r.occurrences for s, r in rows.items()} == {a: 22, b: 12}
    assert rows[a].line_no == 2 and rows[a].source == "a.log" and rows[a].sources == ["a.log", "b.log"]
    assert rows[b].sample_locations == ["a.log:4:4", "a.log:7:4", "a.log:10:4", "a.log:13:5", "a.log:16:5"]
    assert [r.secret for r in groups.ordered(found).collect()] == [a, b]
    assert groups.worst_severity(found) == "critical" and groups.worst_severity(found.where("false")) is None
    assert groups.fails(found, "high") and not groups.fails(found, "none") and not groups.fails(found.where("false"), "info")
    groups.write_baseline(found.where(F.col("secret") == a), tmp_path / "base.json", "n")
    assert a not in (tmp_path / "base.json").read_text()
    known = groups.read_baseline(spark, tmp_path / "base.json")
    assert [r.secret for r in groups.new_groups(found, known).collect()] == [b]
    assert [r.secret for r in groups.known_groups(found, known).collect()] == [a]
    for bad in ("[]", '{"version": 9}', "{"):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            groups.read_baseline(spark, tmp_path / "bad.json")


def test_reports(grouped):
    a, b, _, found, _ = grouped
    payload = json.loads(report.to_json(found, ["a.log"]))
    assert payload["summary"] == {"findings": 2, "occurrences": 34, "by_severity": {"critical": 1, "high": 1}, "sources": ["a.log"], "errors": []}
    assert a not in report.to_json(found) and a in report.to_json(found, with_secret=True)
    lines = report.to_csv(found).splitlines()
    assert lines[0].split(",") == report.CSV_COLUMNS and len(lines) == 3
    sarif = json.loads(report.to_sarif(found, ["broken"]))["runs"][0]
    assert [r["level"] for r in sarif["results"]] == ["error", "error"] and not sarif["invocations"][0]["executionSuccessful"]
    assert [r["id"] for r in sarif["tool"]["driver"]["rules"]] == ["github-personal-access-token", "mailgun-api-key"]
    assert report.export(found, " CSV ") == report.to_csv(found)
    with pytest.raises(ValueError):
        report.export(found, "xml")
    assert a not in report.to_table(found) and a in report.to_table(found, show_secrets=True)


def test_redaction(grouped, tmp_path):
    a, b, lines, found, _ = grouped
    masked = redact.redact_lines(lines, found).collect()
    assert len(masked) == 34 and not any(a in r.line or b in r.line for r in masked) and all(r.masked == 1 for r in masked)
    assert redact.mask_text(a) in masked[1].line
    quoted = 'se"cret\\value-1234567890'
    pairs = redact.replacements([quoted, "short", "é-secret-value-99"])
    line = json.dumps({"a": quoted, "b": "é-secret-value-99"}) + "\r\n"
    (tmp_path / "in.log").write_bytes(line.encode() + b"\xff short\n")
    assert redact.redact_file(str(tmp_path / "in.log"), tmp_path / "out.log", pairs) == 3
    out = (tmp_path / "out.log").read_bytes()
    assert json.loads(out.split(b"\r\n")[0])["a"] == redact.mask_text(quoted) and out.endswith(b"\xff ***** (len=5)\n")


def test_funnel(spark):
    tried = candidates(lines_of(spark, *NEGATIVES, positives()["mailgun-api-key"]), load_rules())
    rows = {(r.rule_id, r.reason): r.candidates for r in groups.noise_funnel(tried).collect()}
    assert rows[("aws-access-key-id", "placeholder-or-doc-example")] == 1 and rows[("mailgun-api-key", "")] == 1
    assert rows[("generic-secret-assignment", "exclude-pattern")] >= 1
