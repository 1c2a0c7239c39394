"""SQL twins of ``stream_queries``."""

from __future__ import annotations

from tidemark.plans.oracle import BASE_MS, CURRENT, EVENTS, HALF, IMAGES, OPS, ORACLE, PROBE, ROW, SOURCE, _w

# creations that nobody repairs, repairs that fail, and those an operator mends.
_LOST = "(k % 101 = 7)"
_FAILED = f"(k % 97 = 13 AND k % 5 = 3 AND NOT {_LOST})"
_MENDED = f"({_FAILED} AND k % 2 = 1)"

_KEPT = CURRENT.replace("FROM images", "FROM kept")

STREAM_ORACLE = {
    "stream_gate": """
      SELECT o_orderkey AS order_id, 'order-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS business_key,
        o_orderkey * 10 + 3 AS event_id, o_custkey AS customer_id, 'paid' AS status,
        CAST(round(o_totalprice * 100) AS BIGINT) AS amount_cents,
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%g') AS updated_at, CAST(17 AS INTEGER) AS seed
      FROM orders WHERE o_orderkey % 2 = 0""",
    "stream_gate_audit": ORACLE["miskey_audit"],
    "stream_gate_isolated": _w(PROBE)
    + """SELECT partition, count(*) AS records, count(DISTINCT order_id) AS orders, max("offset") AS last_offset
      FROM probe WHERE order_id % 2 = 1 GROUP BY partition""",
    "stream_repair": _w(
        IMAGES,
        f"kept AS (SELECT *, order_id AS k FROM images WHERE NOT (cdc_row_kind = '+I' AND ("
        f"{_LOST.replace('k', 'order_id')} OR ({_FAILED.replace('k ', 'order_id ')} AND order_id % 2 = 0))))",
        _KEPT,
    )
    + f"SELECT {ROW} FROM current_rows",
    "stream_repair_states": _w(OPS)
    + f"""SELECT partition, "offset", CASE WHEN {_LOST} THEN 'MalformedEnvelope' ELSE 'UnsupportedOperation' END AS first_error,
      CASE WHEN {_LOST} THEN 'open' WHEN {_FAILED} AND NOT {_MENDED} THEN 'failed' ELSE 'resolved' END AS status,
      CAST(CASE WHEN {_LOST} THEN 0 WHEN {_MENDED} THEN 2 ELSE 1 END AS BIGINT) AS attempts,
      CAST(CASE WHEN {_LOST} OR ({_FAILED} AND NOT {_MENDED}) THEN NULL
                WHEN {_MENDED} AND EXISTS (SELECT 1 FROM log WHERE seq = 1 AND k % 97 = 13 AND NOT {_LOST}) THEN 1 ELSE 0 END AS BIGINT) AS patch,
      CASE WHEN {_LOST} THEN 'MalformedEnvelope' WHEN {_FAILED} AND NOT {_MENDED} THEN 'UnsupportedOperation' END AS last_error
      FROM log WHERE seq = 1 AND ({_LOST} OR k % 97 = 13)""",
    "stream_snapshot": _w(SOURCE) + f"SELECT {ROW} FROM source",
    "stream_snapshot_hand_over": "SELECT true AS several_chunks, true AS past_marks, true AS complete",
    "stream_linkage": """
      SELECT 'run' AS run_id, count(DISTINCT o_orderkey % 3) AS partitions, true AS lag_zero, true AS checkpoint_is_commit,
        true AS snapshots_are_older, true AS complete FROM orders""",
    "stream_dedup": _w(IMAGES)
    + """SELECT partition, cdc_row_kind, count(*) AS images, count(DISTINCT "offset") AS records
      FROM images GROUP BY partition, cdc_row_kind""",
    "rebuild_audit": _w(IMAGES, CURRENT)
    + f"""SELECT 'timestamp' AS rebuild, count(*) > 0 AS differs, count(*) AS missing_keys, CAST(0 AS BIGINT) AS unexpected_keys,
        CAST(0 AS BIGINT) AS changed_keys, CAST(2 AS BIGINT) AS lineages, true AS resolved_after_zero, count(*) = 0 AS matches
      FROM current_rows WHERE order_id NOT IN (SELECT order_id FROM images WHERE source_ts_ms >= {HALF})
      UNION ALL SELECT 'offset 0', false, 0, 0, 0, 2, false, false""",
    "schema_tree_evolution": """
      SELECT 'part-' || CAST(p_partkey AS VARCHAR) AS subject, '' AS removed_fields,
        CASE p_partkey % 11 WHEN 2 THEN 'Address.floor' WHEN 3 THEN 'Address.floor' WHEN 10 THEN 'size' ELSE '' END AS added_fields,
        CASE p_partkey % 11 WHEN 1 THEN 'Address.zip' WHEN 4 THEN 'home' WHEN 5 THEN 'tags[]' WHEN 6 THEN 'state' WHEN 7 THEN 'state'
          ELSE '' END AS changed_field_types,
        CASE p_partkey % 11 WHEN 2 THEN 'Address.floor' ELSE '' END AS added_fields_without_defaults,
        CASE p_partkey % 11 WHEN 5 THEN 'tags[]' WHEN 6 THEN 'State' WHEN 8 THEN 'home' WHEN 9 THEN '$' ELSE '' END AS unreadable,
        p_partkey % 11 NOT IN (2, 5, 6, 8, 9) AS backward_compatible, p_partkey % 11 IN (0, 3, 10) AS passed FROM part""",
    "schema_tree_fields": """
      WITH s AS (SELECT 'part-' || CAST(p_partkey AS VARCHAR) AS subject, CAST(v.v AS INTEGER) AS version,
                   CASE WHEN v.v = 1 THEN -1 ELSE p_partkey % 11 END AS k FROM part, (VALUES (1), (2)) v(v)),
      places(path, types, position, has_default, only_k) AS (VALUES
        ('$', 'named:$', NULL, false, NULL), ('id', 'long', 0, false, NULL), ('origin', 'named:Address', 1, false, NULL),
        ('Address.street', 'string', 0, false, NULL), ('Address.zip', 'int', 1, false, NULL), ('home', 'named:Address', 2, false, NULL),
        ('tags', 'array', 3, false, NULL), ('tags[]', 'string', NULL, false, NULL), ('state', 'named:State', 4, false, NULL),
        ('next', 'named:$,null', 5, true, NULL), ('Address.floor', 'int', 2, false, 2), ('Address.floor', 'int', 2, true, 3),
        ('size', 'map', 6, true, 10), ('size{}', 'long', NULL, false, 10))
      SELECT subject, version, path,
        CASE WHEN path = 'Address.zip' AND k = 1 THEN 'long' WHEN path = 'home' AND k = 4 THEN 'named:Address,null'
             WHEN path = 'home' AND k = 8 THEN 'named:Nowhere' WHEN path = 'tags[]' AND k = 5 THEN 'int' ELSE types END AS types,
        CAST(position AS INTEGER) AS position, has_default,
        CASE WHEN path = 'home' AND k = 8 THEN 'unknown type Nowhere' END AS problem
      FROM s JOIN places ON only_k IS NULL OR only_k = k WHERE k <> 9
      UNION ALL SELECT subject, version, NULL, '', NULL, false, 'schema is not JSON' FROM s WHERE k = 9""",
    "ledger_rules": """
      WITH c AS (SELECT c_custkey AS c, 'record-' || CAST(c_custkey AS VARCHAR) AS name, c_custkey % 6 AS k FROM customer),
      wrong(kind, divisor, rule) AS (VALUES
        (0, 7, 'linkage.lag'), (3, 7, 'linkage.lag'), (4, 7, 'linkage.lag'), (5, 7, 'linkage.lag'), (1, 7, 'continuity'),
        (0, 11, 'environment'), (1, 11, 'environment'), (3, 11, 'environment'), (4, 11, 'environment'), (5, 11, 'environment'),
        (0, 13, 'parity'), (3, 13, 'diff'), (4, 13, 'diff'), (5, 13, 'diff'),
        (0, 17, 'summary'), (1, 17, 'summary'), (3, 17, 'summary'), (4, 17, 'summary'), (5, 17, 'summary'),
        (1, 19, 'checks'), (2, 19, 'effect'), (3, 19, 'checks'), (4, 19, 'checks'), (5, 19, 'checks'),
        (3, 23, 'restart'), (4, 23, 'rebuilds'), (5, 29, 'recoveries'), (1, 31, 'rejection'), (5, 31, 'freshness')),
      kinds(k, kind) AS (VALUES (0, 'parity'), (1, 'schema-contract'), (2, 'small-file-rewrite'), (3, 'broker-restart'), (4, 'offset-replay'), (5, 'slo'))
      SELECT name, kinds.kind, rule FROM c JOIN kinds USING (k) JOIN wrong ON wrong.kind = k AND c % divisor = 0 WHERE c % 41 <> 0 AND c % 43 <> 0
      UNION ALL SELECT name, CASE WHEN c % 43 = 0 THEN 'unknown' ELSE kinds.kind END, 'document' FROM c JOIN kinds USING (k) WHERE c % 41 = 0
      UNION ALL SELECT name, 'unknown', 'kind' FROM c WHERE c % 43 = 0 AND c % 41 <> 0""",
    "event_id_expectations": """
      SELECT count(*) AS source_ids, CAST(0 AS BIGINT) AS source_missing, CAST(0 AS BIGINT) AS source_unexpected,
        count(*) AS current_ids, CAST(0 AS BIGINT) AS current_missing, CAST(0 AS BIGINT) AS current_unexpected,
        count(*) AS changelog_ids, CAST(0 AS BIGINT) AS changelog_missing, CAST(0 AS BIGINT) AS changelog_unexpected,
        count(*) + count(*) FILTER (event_id % 2 = 0) AS changelog_rows, count(*) + count(*) FILTER (event_id % 2 = 0) AS expected_rows,
        true AS current_sets_match, true AS changelog_set_match, true AS changelog_count_match, true AS consistent
      FROM events""",
    "observed_metric_names": """
      WITH n AS (SELECT DISTINCT CASE event_id % 6 WHEN 3 THEN 'source_' || event_type || '_records_lag_max'
          WHEN 5 THEN 'debezium_' || event_type || '_TotalNumberOfEventsSeen' END AS name FROM events)
      SELECT string_agg(name, ',' ORDER BY encode(name)) FILTER (name LIKE 'debezium%') AS connector_metric_names,
        string_agg(name, ',' ORDER BY encode(name)) FILTER (name LIKE '%lag_max') AS lag_metric_names FROM n""",
    "current_in_key_order": _w(IMAGES, CURRENT) + f"SELECT {ROW} FROM current_rows ORDER BY order_id",
    "rows_conform": """
      SELECT o_orderstatus, count(*) AS rows, count(*) FILTER (o_orderkey % 7 <> 0) AS conforming FROM orders GROUP BY o_orderstatus""",
    "stored_files": _w(IMAGES)
    + """SELECT 'changelog' AS dataset, count(*) AS rows, true AS within_limit, true AS all_listed, CAST(1 AS BIGINT) AS folders FROM images
      UNION ALL SELECT d, (SELECT count(DISTINCT order_id) FROM images), true, true, 1 FROM (VALUES ('current'), ('base')) t(d)""",
    "stream_savepoint": _w(SOURCE) + f"SELECT {ROW} FROM source",
    "written_run_record": _w(SOURCE)
    + """SELECT 'record-1' AS name, count(*) AS rows, CAST(0 AS BIGINT) AS snapshot_diff_count,
        'drill.checks,drill.environment,drill.linkage' AS broken FROM source""",
    "visible_in_workload": """
      SELECT snapshot_id, count(*) AS events, max(event_id) AS last_event_id FROM (
        SELECT event_id, event_id // 500 + 1 AS snapshot_id FROM events
        UNION ALL SELECT event_id, event_id // 500 + 2 FROM events WHERE event_id % 2 = 0) GROUP BY snapshot_id""",
}
