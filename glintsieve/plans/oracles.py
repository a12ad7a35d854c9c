"""The queries in SQL for another engine, where SQL can express them."""

from __future__ import annotations

from ..functions import scalar
from ..functions.gate import Gate
from ..operators.rules import load_rules
from .logs import APP_LINES, CLOUD_LINES, CONTAINER_LINES, VALUES

_PLACEHOLDER = "(" + " OR ".join(f"contains(lower({{0}}), '{w}')" for w in scalar.PLACEHOLDERS) + " OR lower({0}) IN (" + ", ".join(f"'{w}'" for w in scalar.DOCUMENTED_SECRETS) + "))"
_ENTROPY = "coalesce(list_sum(list_transform(list_distinct(string_split({0}, '')), lambda c: -((length({0}) - length(replace({0}, c, ''))) / length({0})::DOUBLE) * log2((length({0}) - length(replace({0}, c, ''))) / length({0})::DOUBLE))), 0)"
_CHARSET = (
    "CASE WHEN regexp_full_match({0}, '[0-9a-fA-F]+') THEN 'hex' WHEN regexp_full_match({0}, '[A-Z2-7]+={{0,6}}') THEN 'base32' WHEN regexp_full_match({0}, '[0-9A-Za-z]+') THEN 'base62' "
    "WHEN regexp_full_match({0}, '[0-9A-Za-z_-]+={{0,2}}') AND regexp_matches({0}, '[-_]') THEN 'base64url' WHEN regexp_full_match({0}, '[0-9A-Za-z+/]+={{0,2}}') THEN 'base64' WHEN regexp_full_match({0}, '[0-9A-Za-z_-]+={{0,2}}') THEN 'base64url' ELSE 'printable' END"
)
_SIZE = "CASE " + " ".join(f"WHEN cs = '{k}' THEN {v}" for k, v in scalar.CHARSET_SIZES.items()) + " END"


def _p(x: str) -> str:
    return _PLACEHOLDER.format(x)


_LIKENESS = f"""CASE WHEN length(w) < 4 THEN 0.0 ELSE round(
    0.6 * least(greatest((len(list_filter(list_transform(range(1, greatest(length(w), 2)), lambda i: lower(w)[i:i + 1]), lambda x: list_contains([{", ".join(f"'{b}'" for b in scalar.COMMON_BIGRAMS)}], x))) / (length(w) - 1)::DOUBLE - 0.10) / 0.25, 0.0), 1.0)
  + 0.4 * least(greatest((length(regexp_replace(w, '[^aeiouAEIOU]', '', 'g')) / length(w)::DOUBLE - 0.16) / 0.22, 0.0), 1.0), 4) END"""
# Whether a value (of charset cs) is the base64 of text, by its decoded bytes.
_PLAIN = "translate(rtrim({0}, '='), '-_', '+/')"
_BYTES = f"CASE WHEN cs IN ('base64', 'base64url', 'base62') AND length({_PLAIN}) % 4 != 1 THEN hex(from_base64(rpad({_PLAIN}, CAST(ceil(length({_PLAIN}) / 4.0) * 4 AS INT), '='))) END"
_TEXT = "length({0}) >= 12 AND length(raw) >= 12 AND (left(raw, 2) IN ('7B', '5B') OR left(raw, 10) = '3C3F786D6C' OR len(list_filter(range(0, length(raw) // 2), lambda i: raw[2 * i + 1:2 * i + 2] BETWEEN '20' AND '7E' OR raw[2 * i + 1:2 * i + 2] IN ('09', '0A', '0D'))) / (length(raw) / 2) >= 0.9)"


def _judged(values: str, gate: Gate) -> str:
    """(v, reason) of each value of a select's column v under a gate; null if it is accepted. All steps are done on the value itself."""
    checks = [f"WHEN {_p('v')} THEN 'placeholder-or-doc-example'"] if gate.reject_placeholders else []
    if gate.enabled:
        checks += [f"WHEN length(v) < {gate.min_length} THEN 'too-short'", f"WHEN length(v) > {gate.max_length} THEN 'too-long'"]
        checks += [f"WHEN cs NOT IN ({', '.join(repr(c) for c in sorted(gate.charsets))}) THEN 'charset-not-allowed'"] if gate.charsets else []
        checks += ["WHEN regexp_full_match(v, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}') THEN 'uuid-shape'"] if gate.reject_uuid else []
        checks += [
            "WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}') THEN 'timestamp-shape'", "WHEN regexp_full_match(v, '[0-9.,:+-]+') THEN 'numeric-only'",
            f"WHEN len(list_distinct(string_split(v, ''))) / least(length(v), {_SIZE})::DOUBLE < {gate.min_charset_coverage} THEN 'low-charset-coverage'",
            f"WHEN repeat_run > {gate.max_repeat_run} THEN 'repeated-run'", f"WHEN sequential_run > {gate.max_sequential_run} THEN 'sequential-run'",
            f"WHEN cs NOT IN ('hex', 'base32') AND {_LIKENESS} > {gate.max_word_likeness} THEN 'natural-language-like'",
        ]
        checks += [f"WHEN coalesce({_TEXT.format('v')}, false) THEN 'base64-decodes-to-text'"] if gate.reject_encoded_text else []
        checks += [f"WHEN {_ENTROPY.format('v')} < {gate.min_entropy} THEN 'entropy-below-threshold'", f"WHEN {_ENTROPY.format('v')} / log2({_SIZE}) < {gate.min_normalized} THEN 'normalized-entropy-below-threshold'"]
    return f"""(WITH jv AS (SELECT DISTINCT v FROM ({values})),
     jc AS (SELECT v, unnest(string_split(v, '')) AS ch, unnest(range(1, length(v) + 1)) AS i FROM jv),
     js AS (SELECT v, i, ord(ch) - lag(ord(ch)) OVER (PARTITION BY v ORDER BY i) AS step FROM jc),
     jt AS (SELECT *, CASE WHEN step = lag(step) OVER (PARTITION BY v ORDER BY i) THEN 0 ELSE 1 END AS new FROM js),
     jg AS (SELECT *, sum(new) OVER (PARTITION BY v ORDER BY i) AS run FROM jt),
     jr AS (SELECT v, run, any_value(step) AS step, count(*) + 1 AS n FROM jg GROUP BY v, run),
     ju AS (SELECT v, coalesce(max(n) FILTER (step = 0), 1) AS repeat_run, coalesce(max(n) FILTER (abs(step) = 1), 1) AS sequential_run FROM jr GROUP BY v),
     jn AS (SELECT *, {_CHARSET.format("v")} AS cs, regexp_replace(v, '[^A-Za-z]', '', 'g') AS w FROM ju),
     jb AS (SELECT *, {_BYTES.format("v")} AS raw FROM jn)
SELECT v, {"CASE " + " ".join(checks) + " END" if checks else "NULL"} AS reason FROM jb)"""


def _gate_of(rule_id: str) -> Gate:
    return load_rules().get(rule_id).gate


_LINES = """
SELECT 'doc-' || doc_id AS source, i AS line_no, regexp_replace(x, '\\r$', '') AS line, x AS raw, l, i
FROM (SELECT doc_id, l, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i
      FROM (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
"""

# The four rules whose shape is proof, on the application lines.
_STRUCTURAL = f"""
app AS ({APP_LINES}), hits AS (
    SELECT source, line_no, 'aws-access-key-id' AS rule_id, 'critical' AS severity, unnest(regexp_extract_all(line, '\\bAKIA[A-Z0-9]{{{{16}}}}\\b')) AS secret, line FROM app
    UNION ALL SELECT source, line_no, 'github-personal-access-token', 'critical', unnest(regexp_extract_all(line, '\\bghp_[A-Za-z0-9]{{{{36,255}}}}\\b')), line FROM app
    UNION ALL SELECT source, line_no, 'mailgun-api-key', 'high', unnest(regexp_extract_all(line, '\\bkey-[0-9a-f]{{{{32}}}}\\b')), line FROM app
    UNION ALL SELECT source, line_no, 'twilio-account-sid', 'medium', unnest(regexp_extract_all(line, '\\bAC[0-9a-fA-F]{{{{32}}}}\\b')), line FROM app WHERE contains(line, 'twilio')
), accepted AS (
    SELECT source, line_no, rule_id, severity, secret, instr(line, secret) AS col FROM hits WHERE NOT {_p("secret")}
), named AS (
    SELECT *, substr(sha256(rule_id || chr(0) || secret), 1, 16) AS fingerprint FROM accepted
)
""".replace("{{{{", "{").replace("}}}}", "}").replace("{{", "{").replace("}}", "}")

# The first schema whose telling fields a JSON record has.
_HAS = "(j -> '$.{0}') IS NOT NULL"
_SCHEMA = "CASE " + " ".join(
    f"WHEN {' AND '.join(f'({_HAS.format(x)})' if x[0] != '(' else x for x in fields)} THEN '{name}'"
    for name, fields in (
        ("aws-cloudtrail", ("eventVersion", "eventSource")), ("gcp-cloud-logging", ("logName", "insertId")), ("kubernetes-audit", ("(starts_with(j ->> '$.apiVersion', 'audit.k8s.io'))",)),
        ("azure-activity-log", ("operationName", "resourceId")), ("elastic-common-schema", ('"@timestamp"', "(json_type(j, '$.event') = 'OBJECT')")), ("jvm-json-log", ("logger_name", "level")),
    )
) + " ELSE 'generic-json' END"

_MASKED = "CASE WHEN length({0}) = 0 THEN '<empty>' WHEN length({0}) <= 10 THEN repeat('*', length({0})) || ' (len=' || length({0}) || ')' ELSE left({0}, 4) || repeat('*', least(length({0}) - 8, 8)) || right({0}, 4) || ' (len=' || length({0}) || ')' END"

ORACLE_SQL: dict[str, str] = {
    "scan_lines": f"SELECT source, line_no, line FROM ({_LINES})",
    "line_offsets": f"SELECT source, line_no, CAST(coalesce(list_sum(list_transform(l[1:i - 1], lambda y: strlen(y) + 1)), 0) AS BIGINT) AS byte_offset FROM ({_LINES})",
    "entropy_profile": f"""
WITH v AS (SELECT id, value, {_CHARSET.format("value")} AS cs, len(list_distinct(string_split(value, ''))) AS d FROM ({VALUES}))
SELECT id, round({_ENTROPY.format("value")}, 6) AS entropy, round(d / length(value)::DOUBLE, 6) AS unique_ratio, round(d / least(length(value), {_SIZE})::DOUBLE, 6) AS coverage FROM v""",
    "charset_distribution": f"SELECT {_CHARSET.format('value')} AS charset, count(*) AS n FROM ({VALUES}) GROUP BY 1",
    "word_likeness": f"""
WITH v AS (SELECT id, regexp_replace(value, '[^A-Za-z]', '', 'g') AS w FROM ({VALUES})),
     p AS (SELECT id, w, length(w) AS n, list_transform(range(1, greatest(length(w), 2)), lambda i: lower(w)[i:i + 1]) AS pairs FROM v)
SELECT id, CASE WHEN n < 4 THEN 0.0 ELSE round(
    0.6 * least(greatest((len(list_filter(pairs, lambda x: list_contains([{", ".join(f"'{b}'" for b in scalar.COMMON_BIGRAMS)}], x))) / (n - 1)::DOUBLE - 0.10) / 0.25, 0.0), 1.0)
  + 0.4 * least(greatest((length(regexp_replace(w, '[^aeiouAEIOU]', '', 'g')) / n::DOUBLE - 0.16) / 0.22, 0.0), 1.0), 4) END AS word_likeness FROM p""",
    "runs": f"""
WITH c AS (SELECT id, unnest(string_split(value, '')) AS ch, unnest(range(1, length(value) + 1)) AS i FROM ({VALUES})),
     s AS (SELECT id, i, ord(ch) - lag(ord(ch)) OVER (PARTITION BY id ORDER BY i) AS step FROM c),
     t AS (SELECT *, CASE WHEN step = lag(step) OVER (PARTITION BY id ORDER BY i) THEN 0 ELSE 1 END AS new FROM s),
     g AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY i) AS run FROM t),
     r AS (SELECT id, run, any_value(step) AS step, count(*) + 1 AS n FROM g GROUP BY id, run)
SELECT id, coalesce(max(n) FILTER (step = 0), 1) AS repeat_run, coalesce(max(n) FILTER (abs(step) = 1), 1) AS sequential_run FROM r GROUP BY id""",
    "value_shapes": f"""
SELECT id, {_p("value")} AS placeholder, regexp_full_match(value, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}') AS uuid,
       regexp_matches(value, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}') AS timestamp, regexp_full_match(value, '[0-9.,:+-]+') AS numeric FROM ({VALUES})""",
    "masks": f"SELECT id, {_MASKED.format('value')} AS masked, substr(sha256('some-rule' || chr(0) || value), 1, 16) AS fingerprint FROM ({VALUES})",
    "json_leaves": f"SELECT event_id, replace(substr(fullkey, 3), chr(34), '') AS path, atom ->> '$' AS value FROM (SELECT line_no AS event_id, t.* FROM ({CLOUD_LINES}) c, json_tree(c.line) t) WHERE type = 'VARCHAR' UNION ALL SELECT line_no, 'body.signing_key', md5(CAST(line_no AS STRING)) FROM ({CLOUD_LINES}) WHERE line_no % 7 = 6",
    "schema_counts": f"WITH r AS (SELECT CAST(line AS JSON) AS j FROM ({CLOUD_LINES})) SELECT {_SCHEMA} AS schema, count(*) AS n FROM r GROUP BY 1",
    "cloud_contexts": f"""
WITH r AS (SELECT line_no AS event_id, CAST(line AS JSON) AS j FROM ({CLOUD_LINES})), s AS (SELECT *, {_SCHEMA} AS schema FROM r)
SELECT event_id,
       CASE schema WHEN 'aws-cloudtrail' THEN 'AWS IAM User (' || (j ->> '$.userIdentity.userName') || ')' WHEN 'gcp-cloud-logging' THEN 'GCP Principal (' || (j ->> '$.protoPayload.authenticationInfo.principalEmail') || ')'
         WHEN 'kubernetes-audit' THEN 'K8s User (' || (j ->> '$.user.username') || ')' WHEN 'azure-activity-log' THEN 'Azure Identity (' || (j ->> '$.caller') || ')' WHEN 'jvm-json-log' THEN 'MDC user (' || (j ->> '$.mdc.userId') || ')'
         WHEN 'elastic-common-schema' THEN 'User (' || (j ->> '$.user.name') || ')' ELSE 'User (' || (j ->> '$.user') || ')' END AS actor,
       CASE schema WHEN 'aws-cloudtrail' THEN j ->> '$.eventName' WHEN 'gcp-cloud-logging' THEN j ->> '$.protoPayload.methodName' WHEN 'kubernetes-audit' THEN (j ->> '$.verb') || ' ' || (j ->> '$.objectRef.resource')
         WHEN 'azure-activity-log' THEN j ->> '$.operationName' WHEN 'elastic-common-schema' THEN j ->> '$.event.action' WHEN 'generic-json' THEN j ->> '$.action' END AS action FROM s""",
    "keyed_rule_hits": f"""
WITH s AS (SELECT event_id, md5(CAST(event_id AS STRING)) AS secret FROM events)
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'requestParameters.password' WHEN 1 THEN 'protoPayload.request.token' WHEN 2 THEN 'annotations.secret' WHEN 3 THEN 'properties.client_secret' WHEN 4 THEN 'labels.api_key' WHEN 5 THEN 'mdc.passphrase' ELSE 'body.signing_key' END AS json_path, secret
FROM s WHERE NOT {_p("secret")} AND {_ENTROPY.format("secret")} >= 3.2""",
    "vendor_prefixes": f"WITH {_STRUCTURAL} SELECT source, line_no, rule_id, secret, col AS column FROM named",
    "keyword_required": f"""
WITH app AS ({APP_LINES}), h AS (SELECT line, unnest(regexp_extract_all(line, '\\bAC[0-9a-fA-F]{{32}}\\b')) AS secret FROM app WHERE regexp_matches(lower(line), 'twilio|auth_token|account_sid')),
     w AS (SELECT regexp_matches(lower(substr(line, greatest(1, instr(line, secret) - 96), 96 + length(secret))), 'twilio|auth_token|account_sid') AS near, {_p("secret")} AS placeholder FROM h)
SELECT CASE WHEN NOT near THEN 'keyword' WHEN placeholder THEN 'entropy' ELSE 'accepted' END AS outcome, CASE WHEN NOT near THEN 'missing-required-keyword' WHEN placeholder THEN 'placeholder-or-doc-example' END AS reason, count(*) AS n FROM w GROUP BY 1, 2""",
    "database_uris": f"WITH s AS (SELECT CAST(o_orderkey AS BIGINT) AS line_no, substr(md5(CAST(o_orderkey AS STRING)), 1, 14) AS secret FROM orders WHERE o_orderkey % 50 = 2) SELECT line_no, secret FROM s WHERE NOT {_p('secret')} AND NOT regexp_full_match(secret, '[0-9]+') AND {_ENTROPY.format('secret')} >= 1.8 AND len(list_distinct(string_split(secret, ''))) / 14.0 >= 0.35",
    "document_secrets": f"""
WITH l AS ({_LINES}), h AS (SELECT source, line_no, unnest(regexp_extract_all(line, '(?i)token = "([0-9a-f]{{40}})"', 1)) AS secret FROM l)
SELECT DISTINCT source, line_no, secret FROM h WHERE NOT {_p("secret")} AND {_ENTROPY.format("secret")} >= 3.1""",
    "groups_by_fingerprint": f"WITH {_STRUCTURAL} SELECT fingerprint, any_value(rule_id) AS rule_id, any_value({_MASKED.format('secret')}) AS secret_masked, arg_min(line_no, struct_pack(a := source, b := line_no, c := col)) AS line_no, count(*) AS occurrences, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM named GROUP BY fingerprint",
    "top_groups": f"WITH {_STRUCTURAL} SELECT fingerprint, count(*) AS occurrences FROM named GROUP BY fingerprint, rule_id, severity ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, count(*) DESC, rule_id, fingerprint LIMIT 20",
    "sample_locations": f"""WITH {_STRUCTURAL}, n AS (SELECT fingerprint, source || ':' || line_no || ':' || col AS place, row_number() OVER (PARTITION BY fingerprint ORDER BY source, line_no, col) AS n FROM named)
SELECT fingerprint, coalesce(string_agg(place, ',' ORDER BY n) FILTER (n BETWEEN 2 AND 6), '') AS sample_locations FROM n GROUP BY fingerprint""",
    "severity_counts": f"WITH {_STRUCTURAL} SELECT severity, count(DISTINCT fingerprint) AS findings, count(*) AS occurrences FROM named GROUP BY severity",
    "baseline_new": f"WITH {_STRUCTURAL} SELECT DISTINCT fingerprint, rule_id FROM named WHERE rule_id != 'mailgun-api-key'",
    "baseline_known": f"WITH {_STRUCTURAL} SELECT DISTINCT fingerprint, rule_id FROM named WHERE rule_id = 'mailgun-api-key'",
    "per_source_cap": f"WITH {_STRUCTURAL} SELECT source, line_no FROM (SELECT source, line_no, row_number() OVER (PARTITION BY source ORDER BY line_no) AS n FROM named WHERE rule_id = 'github-personal-access-token') WHERE n <= 5",
    "base64_layer": f"WITH {_STRUCTURAL} SELECT source, line_no, secret, 'base64' AS encoding, CAST(instr('payload ' || to_base64(CAST(line AS BLOB)), to_base64(CAST(line AS BLOB))) AS BIGINT) AS column FROM hits WHERE rule_id = 'github-personal-access-token' AND NOT {_p('secret')}",
    "redact_lines": f"WITH {_STRUCTURAL}, t AS (SELECT source, line_no, any_value(secret) AS secret FROM named WHERE rule_id = 'github-personal-access-token' GROUP BY 1, 2) SELECT a.source, a.line_no, CASE WHEN t.secret IS NULL THEN a.line ELSE replace(a.line, t.secret, {_MASKED.format('t.secret')}) END AS line FROM app a LEFT JOIN t ON a.source = t.source AND a.line_no = t.line_no",
    "redact_counts": f"WITH {_STRUCTURAL} SELECT source, CAST(count(*) FILTER (contains(line, ' ghp_')) AS BIGINT) AS masked FROM app GROUP BY source",
    "container_lines": f"""
WITH c AS ({CONTAINER_LINES}),
     r AS (SELECT source, line_no, CASE line_no % 4 WHEN 3 THEN 'stderr' ELSE 'stdout' END AS stream, CASE WHEN line_no % 4 = 3 THEN NULL ELSE 't' || line_no END AS time, CASE line_no % 4 WHEN 1 THEN 'part ' || line_no || ' ' WHEN 2 THEN 'end ' || line_no ELSE 'whole ' || line_no END AS text, line_no % 4 IN (2, 3) AS ended FROM c WHERE line_no % 4 != 0),
     g AS (SELECT *, coalesce(sum(ended::INT) OVER (PARTITION BY source, stream ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM r)
SELECT source, stream, arg_min(time, line_no) AS time, min(line_no) AS first_line, max(line_no) AS last_line, string_agg(text, '' ORDER BY line_no) AS text FROM g GROUP BY source, stream, island
UNION ALL SELECT source, '', NULL, line_no, line_no, line FROM c WHERE line_no % 4 = 0""",
    "rule_packs": "SELECT * FROM (VALUES ('aws', 7, 6), ('azure', 6, 6), ('database', 5, 5), ('gcp', 7, 7), ('generic', 6, 4), ('private-keys', 6, 6), ('vendors', 29, 29)) t(pack, rules, enabled)",
    "screen_keeps_findings": "SELECT CAST('' AS VARCHAR) AS rule_id, CAST(0 AS BIGINT) AS lost WHERE false",
    "stream_scan": f"WITH {_STRUCTURAL} SELECT fingerprint, count(*) AS occurrences FROM named GROUP BY fingerprint",
    "encoded_text": f"""
WITH c AS (SELECT id, CASE WHEN id % 2 = 0 THEN to_base64(CAST('{{"user":"' || value || '"}}' AS BLOB)) ELSE to_base64(unhex(sha256(value))) END AS v FROM ({VALUES})),
     n AS (SELECT *, {_CHARSET.format("v")} AS cs FROM c), b AS (SELECT *, {_BYTES.format("v")} AS raw FROM n)
SELECT id, coalesce({_TEXT.format("v")}, false) AS encoded_text FROM b""",
    "gate_verdicts": f"SELECT id, coalesce(reason, 'accepted') AS verdict FROM ({VALUES}) x JOIN {_judged(f'SELECT value AS v FROM ({VALUES})', Gate())} j ON x.value = j.v",
    "noise_funnel": f"""
WITH {_STRUCTURAL}, g AS (SELECT unnest(regexp_extract_all(line, 'password=([^\\s"'',;}}{{)\\]]{{10,120}})', 1)) AS v FROM app),
     j AS (SELECT g.v, reason FROM g JOIN {_judged("SELECT v FROM g", _gate_of("generic-secret-assignment"))} r ON g.v = r.v)
SELECT rule_id, CASE WHEN {_p("secret")} THEN 'entropy' ELSE 'accepted' END AS outcome, CASE WHEN {_p("secret")} THEN 'placeholder-or-doc-example' ELSE '' END AS reason, count(*) AS candidates FROM hits GROUP BY 1, 2, 3
UNION ALL SELECT 'generic-secret-assignment', CASE WHEN reason IS NULL THEN 'accepted' ELSE 'entropy' END, coalesce(reason, ''), count(*) FROM j GROUP BY 1, 2, 3""",
    "match_cap": f"WITH app AS ({APP_LINES}), k AS (SELECT source, line_no, regexp_extract_all(line, '\\bAKIA[A-Z0-9]{{16}}\\b') AS keys FROM app WHERE contains(line, 'AKIA')) SELECT source, line_no, CAST(least(8, 10 * len(list_filter(keys, lambda x: NOT {_p('x')}))) AS BIGINT) AS accepted FROM k",
    "overlap_collapse": f"""
WITH app AS ({APP_LINES}), k AS (SELECT source, line_no, regexp_extract(line, 'ghp_[a-z0-9]+') AS secret FROM app WHERE contains(line, 'ghp_'))
SELECT source, line_no, 'github-personal-access-token' AS rule_id, CASE WHEN reason IS NULL THEN 'also-matched:authorization-header-bearer' ELSE '' END AS absorbed
FROM k JOIN {_judged("SELECT secret AS v FROM k", _gate_of("authorization-header-bearer"))} j ON k.secret = j.v WHERE NOT {_p("secret")}""",
    # Every built-in rule, by its name, on its sample.
    "rule_samples": "SELECT rule_id, CAST(1 AS BIGINT) AS samples FROM (VALUES " + ", ".join(f"('{r.id}')" for r in load_rules().rules) + ") t(rule_id)",
}
