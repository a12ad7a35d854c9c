"""Log lines made from the driver's tables, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

#: Application lines from orders, some with a credential; every kind is one remainder of the key.
APP_LINES = """
SELECT 'app-' || CAST(o_custkey % 7 AS STRING) || '.log' AS source, CAST(o_orderkey AS BIGINT) AS line_no, CAST(0 AS BIGINT) AS byte_offset,
       'INFO order=' || CAST(o_orderkey AS STRING) || ' status=' || o_orderstatus ||
       CASE o_orderkey % 50
         WHEN 0 THEN ' accessKeyId=AKIA' || upper(substr(md5(CAST(o_orderkey % 2000 AS STRING)), 1, 16))
         WHEN 1 THEN ' using ghp_' || md5(CAST(o_orderkey % 2000 AS STRING)) || 'abcd done'
         WHEN 2 THEN ' url postgres://svc:' || substr(md5(CAST(o_orderkey AS STRING)), 1, 14) || '@db.internal/x'
         WHEN 3 THEN ' password=' || md5(CAST(o_orderkey AS STRING))
         WHEN 4 THEN ' twilio sid AC' || md5(CAST(o_orderkey AS STRING))
         WHEN 5 THEN ' other sid AC' || md5(CAST(o_orderkey AS STRING))
         WHEN 6 THEN ' sent with key-' || md5(CAST(o_orderkey % 3000 AS STRING))
         WHEN 7 THEN ' password=changeme' || CAST(o_orderkey AS STRING) || 'xyz'
         WHEN 8 THEN ' keys AKIA' || upper(substr(md5(CAST(o_orderkey AS STRING)), 1, 16)) || ' AKIA' || upper(substr(md5(CAST(o_orderkey AS STRING)), 17, 16))
         ELSE '' END AS line
FROM orders
"""

#: JSON records of seven schemas from events, each with a secret under a telling key.
CLOUD_LINES = """
SELECT 'cloud-' || CAST(event_id % 7 AS STRING) || '.jsonl' AS source, CAST(event_id AS BIGINT) AS line_no, CAST(0 AS BIGINT) AS byte_offset,
       CASE event_id % 7
         WHEN 0 THEN '{"eventVersion":"1.08","eventSource":"s3.amazonaws.com","eventName":"' || event_type || '","userIdentity":{"type":"IAMUser","userName":"user' || CAST(user_id AS STRING) || '"},"requestParameters":{"password":"' || md5(CAST(event_id AS STRING)) || '","tags":["a","' || event_type || '"]}}'
         WHEN 1 THEN '{"logName":"projects/p/logs/x","insertId":"i' || CAST(event_id AS STRING) || '","protoPayload":{"methodName":"' || event_type || '","authenticationInfo":{"principalEmail":"u' || CAST(user_id AS STRING) || '@example.org"},"request":{"token":"' || md5(CAST(event_id AS STRING)) || '"}}}'
         WHEN 2 THEN '{"kind":"Event","apiVersion":"audit.k8s.io/v1","verb":"' || event_type || '","user":{"username":"user' || CAST(user_id AS STRING) || '"},"objectRef":{"resource":"pods"},"annotations":{"secret":"' || md5(CAST(event_id AS STRING)) || '"}}'
         WHEN 3 THEN '{"operationName":"' || event_type || '","resourceId":"/sub/1","caller":"user' || CAST(user_id AS STRING) || '","properties":{"client_secret":"' || md5(CAST(event_id AS STRING)) || '"}}'
         WHEN 4 THEN '{"@timestamp":"2024-01-01T00:00:00Z","event":{"action":"' || event_type || '"},"user":{"name":"user' || CAST(user_id AS STRING) || '"},"labels":{"api_key":"' || md5(CAST(event_id AS STRING)) || '"}}'
         WHEN 5 THEN '{"logger_name":"c.x.Y","level":"INFO","message":"m","mdc":{"userId":"user' || CAST(user_id AS STRING) || '","passphrase":"' || md5(CAST(event_id AS STRING)) || '"}}'
         ELSE '{"user":"user' || CAST(user_id AS STRING) || '","action":"' || event_type || '","body":"{' || chr(92) || '"signing_key' || chr(92) || '":' || chr(92) || '"' || md5(CAST(event_id AS STRING)) || chr(92) || '"}"}' END AS line
FROM events
"""

#: Values of many kinds from customers, for the scalar functions.
VALUES = """
SELECT CAST(c_custkey AS BIGINT) AS id,
       CASE c_custkey % 9
         WHEN 0 THEN md5(CAST(c_custkey AS STRING))
         WHEN 1 THEN upper(substr(md5(CAST(c_custkey AS STRING)), 1, 20))
         WHEN 2 THEN substr(md5(CAST(c_custkey AS STRING)), 1, 8) || '-' || substr(md5(CAST(c_custkey AS STRING)), 9, 4) || '-' || substr(md5(CAST(c_custkey AS STRING)), 13, 4) || '-' || substr(md5(CAST(c_custkey AS STRING)), 17, 4) || '-' || substr(md5(CAST(c_custkey AS STRING)), 21, 12)
         WHEN 3 THEN 'thequickbrownfox' || CAST(c_custkey AS STRING) || 'jumpsoverthelazydog'
         WHEN 4 THEN 'your_' || md5(CAST(c_custkey AS STRING))
         WHEN 5 THEN '2024-01-02T03:04:' || CAST(c_custkey AS STRING)
         WHEN 6 THEN CAST(c_custkey AS STRING) || '00112233.44'
         WHEN 7 THEN 'Zq' || md5(CAST(c_custkey AS STRING)) || '-X_y'
         ELSE 'k' || CAST(c_custkey AS STRING) END AS value
FROM customer
"""

#: Container records from orders: of every four, two are joined and one is no record.
CONTAINER_LINES = """
SELECT 'c-' || CAST(o_custkey % 5 AS STRING) AS source, CAST(o_orderkey AS BIGINT) AS line_no,
       CASE o_orderkey % 4
         WHEN 0 THEN 'plain ' || CAST(o_orderkey AS STRING)
         WHEN 1 THEN '{"log":"part ' || CAST(o_orderkey AS STRING) || ' ","stream":"stdout","time":"t' || CAST(o_orderkey AS STRING) || '"}'
         WHEN 2 THEN '{"log":"end ' || CAST(o_orderkey AS STRING) || chr(92) || 'n","stream":"stdout","time":"t' || CAST(o_orderkey AS STRING) || '"}'
         ELSE '{"log":"whole ' || CAST(o_orderkey AS STRING) || chr(92) || 'n","stream":"stderr"}' END AS line
FROM orders
"""
