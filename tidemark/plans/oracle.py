"""The registered queries as plain SQL over the driver's tables.

Each text computes its answer from the raw tables, without the change log
format: the images come from a UNION over the orders.
"""

from __future__ import annotations

BASE_MS = 1767225600000
T = "strftime({}, '%Y-%m-%d %H:%M:%S.%g')"


def _ts(c: str) -> str:
    return T.format(c)


def _row(version: str) -> str:
    """Columns of an order image in a version (1 as created, 2 updated)."""
    return f"""
      k AS order_id, 'order-' || lpad(CAST(k AS VARCHAR), 12, '0') AS business_key,
      k * 10 + {version} AS event_id, o_custkey AS customer_id,
      CASE WHEN {version} = 2 THEN 'shipped' WHEN o_orderstatus = 'F' THEN 'delivered'
           WHEN o_orderstatus = 'O' THEN 'created' ELSE 'paid' END AS status,
      CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN {version} = 2 THEN 7 ELSE 0 END AS amount_cents,
      strftime(o_orderdate + CASE WHEN {version} = 2 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END,
               '%Y-%m-%d %H:%M:%S.%g') AS updated_at,
      CAST(17 AS INTEGER) AS seed"""


ROW = "order_id, business_key, event_id, customer_id, status, amount_cents, updated_at, seed"

OPS = """
ops AS (
  SELECT o.*, o_orderkey AS k, CAST(o_orderkey % 3 AS INTEGER) AS partition, s.seq AS seq
  FROM orders o JOIN (VALUES (1), (2), (3)) s(seq)
    ON s.seq = 1 OR (s.seq = 2 AND o_orderkey % 2 = 0) OR (s.seq = 3 AND o_orderkey % 5 = 0)),
log AS (
  SELECT *, row_number() OVER (PARTITION BY partition ORDER BY seq, k) - 1 AS "offset" FROM ops)"""

IMAGES = OPS + f""",
versioned AS (
  SELECT *, 0 AS image_seq, '+I' AS kind,
         CASE WHEN k % 10 = 0 THEN 'snapshot' ELSE 'insert' END AS operation, 1 AS v FROM log WHERE seq = 1
  UNION ALL SELECT *, 0, '-U', 'update_before', 1 FROM log WHERE seq = 2
  UNION ALL SELECT *, 1, '+U', 'update_after', 2 FROM log WHERE seq = 2
  UNION ALL SELECT *, 0, '-D', 'delete', CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END FROM log WHERE seq = 3),
images AS (
  SELECT partition, "offset", CAST(image_seq AS INTEGER) AS image_seq, {_row('v')},
         kind AS cdc_row_kind, operation AS cdc_operation,
         {BASE_MS} + "offset" * 1000 AS source_ts_ms FROM versioned)"""

SOURCE = f"""
source AS (
  SELECT {_row('v')} FROM (
    SELECT *, o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS v
    FROM orders WHERE o_orderkey % 5 <> 0))"""

# current state straight from the images
CURRENT = f"""
latest AS (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY partition DESC, "offset" DESC, image_seq DESC) AS rn
  FROM images WHERE cdc_row_kind <> '-U'),
current_rows AS (SELECT {ROW} FROM latest WHERE rn = 1 AND cdc_row_kind <> '-D')"""

CORRUPTED = """
corrupted AS (
  SELECT * REPLACE (amount_cents + CASE WHEN order_id % 50 = 7 THEN 1 ELSE 0 END AS amount_cents)
  FROM source WHERE order_id % 100 <> 31)"""

HALF = f"(SELECT {BASE_MS} + (max(\"offset\") * 1000) // 2 FROM log)"

PROBE = """
probe AS (
  SELECT o_orderkey AS order_id, i.i AS i,
         o_orderkey * 10 + CASE WHEN o_orderkey % 2 = 1 AND i.i > 0 THEN 4 - i.i ELSE i.i + 1 END AS event_id,
         CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey + 100 + i.i ELSE o_orderkey END AS key_order_id,
         CAST(CASE WHEN o_orderkey % 2 = 1 THEN i.i ELSE o_orderkey % 3 END AS INTEGER) AS partition,
         o_orderkey * 3 + i.i AS "offset"
  FROM orders, (VALUES (0), (1), (2)) i(i)),
stepped AS (
  SELECT *, lag(event_id) OVER (PARTITION BY order_id ORDER BY i) AS prev_event,
         lag("offset") OVER (PARTITION BY order_id ORDER BY i) AS prev_offset FROM probe)"""

HASHED = """
hashed AS (
  SELECT order_id, sha256(concat_ws(chr(31), CAST(order_id AS VARCHAR), business_key, CAST(event_id AS VARCHAR),
    CAST(customer_id AS VARCHAR), status, CAST(amount_cents AS VARCHAR), updated_at, CAST(seed AS VARCHAR))) AS h
  FROM source),
words AS (
  SELECT order_id, 1::HUGEINT AS n,
         CAST('0x' || substr(h, 1, 15) AS BIGINT)::HUGEINT AS a, CAST('0x' || substr(h, 16, 15) AS BIGINT)::HUGEINT AS b,
         CAST('0x' || substr(h, 31, 15) AS BIGINT)::HUGEINT AS c, CAST('0x' || substr(h, 46, 15) AS BIGINT)::HUGEINT AS d
  FROM hashed)"""

EVENTS = """
e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events),
batches AS (
  SELECT event_id // 100 AS batch_id, min(event_id) AS first_event_id, max(event_id) AS last_event_id,
         count(*) AS event_count, min(ms) AS request_started_epoch_ms, max(ms) AS commit_ack_epoch_ms,
         max(ms) - min(ms) AS client_round_trip_ms
  FROM e GROUP BY 1),
snapshots AS (
  SELECT event_id // 500 + 1 AS snapshot_id, max(ms) + 5000 + event_id // 500 + 1 AS committed_at_epoch_ms
  FROM e GROUP BY event_id // 500),
samples AS (
  SELECT e.event_id, s.snapshot_id, s.committed_at_epoch_ms, s.committed_at_epoch_ms - b.commit_ack_epoch_ms AS latency_ms
  FROM e JOIN snapshots s ON s.snapshot_id = e.event_id // 500 + 1 JOIN batches b ON b.batch_id = e.event_id // 100)"""

METRICS = """
metrics AS (
  SELECT event_id, user_id AS scrape, value AS metric_value, CAST(user_id % 3 AS VARCHAR) AS job,
         't' || CAST(user_id % 7 AS VARCHAR) AS task, event_id % 6 AS turn,
         CASE event_id % 6 WHEN 0 THEN 'job_' || event_type || '_busyTimeMsPerSecond'
           WHEN 1 THEN 'job_' || event_type || '_backPressuredTimeMsPerSecond'
           WHEN 2 THEN 'job_' || event_type || '_checkpointAlignmentTime'
           WHEN 3 THEN 'source_' || event_type || '_records_lag_max'
           WHEN 4 THEN 'source_' || event_type || '_committedOffsets'
           ELSE 'debezium_' || event_type || '_TotalNumberOfEventsSeen' END AS name
  FROM events)"""

LOAD = """
load AS (
  SELECT event_type AS series, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS sample_index,
         greatest(count(*) - 67, 0) AS lag_events, max(value) AS duration_ms, min(value) AS alignment_ms,
         max(value / 1000) AS indicator, count(*) FILTER (value > 100) AS failed_count
  FROM events GROUP BY 1, 2),
phased AS (
  SELECT *, CASE WHEN sample_index < 3 THEN 'baseline' WHEN lag_events > 0 THEN 'backpressure' ELSE 'recovery' END AS phase
  FROM load),
summary AS (
  SELECT count(*) AS samples, max(duration_ms) FILTER (phase = 'baseline') AS baseline_duration_ms,
         max(duration_ms) FILTER (phase <> 'baseline') AS load_duration_ms,
         max(alignment_ms) FILTER (phase = 'baseline') AS baseline_alignment_ms,
         max(alignment_ms) FILTER (phase <> 'baseline') AS load_alignment_ms,
         max(indicator) FILTER (phase <> 'baseline') AS peak_indicator,
         max(lag_events) FILTER (phase <> 'baseline') AS peak_lag,
         max(failed_count) AS failed_count FROM phased)"""

# the last sample is unique per series, so the overall summary needs a tie rule of its own
CHECKS = LOAD + """,
final AS (SELECT lag_events AS final_lag FROM phased ORDER BY sample_index DESC, lag_events DESC LIMIT 1),
checks AS (
  SELECT 'checkpoint_duration_rose' AS check_name, coalesce(load_duration_ms > baseline_duration_ms, false) AS passed FROM summary
  UNION ALL SELECT 'alignment_time_rose', coalesce(load_alignment_ms > baseline_alignment_ms, false) FROM summary
  UNION ALL SELECT 'checkpoint_failure_count_recorded', failed_count IS NOT NULL FROM summary
  UNION ALL SELECT 'backpressure_observed', coalesce(peak_indicator, 0) >= 0.05 FROM summary
  UNION ALL SELECT 'commit_lag_observed', coalesce(peak_lag, 0) > 0 FROM summary
  UNION ALL SELECT 'lag_recovered', final_lag = 0 FROM final)"""

RUNS = """
runs AS (
  SELECT CASE o_orderkey % 5 WHEN 0 THEN 'duplicate-redelivery' WHEN 1 THEN 'mis-keying' WHEN 2 THEN 'poison-dlq'
           WHEN 3 THEN 'offset-replay' ELSE 'broker-restart' END AS failure_class,
         CAST(o_custkey % 60 + 1 AS DOUBLE) AS recovery_seconds,
         CASE WHEN o_orderkey % 101 = 0 THEN 1 ELSE 0 END AS diff,
         o_orderkey % 103 <> 0 AS audit_ok, o_orderkey % 107 <> 0 AS passed FROM orders),
classes AS (
  SELECT failure_class, count(*) AS runs, max(recovery_seconds) AS max_recovery_seconds, bool_and(diff = 0) AS all_diffs_zero
  FROM runs GROUP BY 1)"""

RATES = """
rates AS (
  SELECT CAST(sum(event_count) AS BIGINT) AS rows,
    greatest((max(commit_ack_epoch_ms) - min(request_started_epoch_ms)) / 1000.0::DOUBLE, 0.001) AS src,
    greatest(((SELECT max(committed_at_epoch_ms) FROM snapshots) - min(request_started_epoch_ms)) / 1000.0::DOUBLE, 0.001) AS tot
  FROM batches)"""


def _w(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


FIELDS = """
fields AS (
  SELECT 'part-' || CAST(p_partkey AS VARCHAR) AS subject, p_partkey, CAST(v.v AS INTEGER) AS version, f.f AS field,
         f.f = 'brand' AND p_partkey % 6 = 1 AS has_default
  FROM part, (VALUES (1), (2)) v(v), (VALUES ('p_partkey'), ('p_size'), ('updated_at'), ('brand')) f(f)
  WHERE NOT (f.f = 'brand' AND (v.v = 1 OR p_partkey % 6 NOT IN (1, 4)))
    AND NOT (f.f = 'p_size' AND v.v = 2 AND p_partkey % 6 = 2))"""


def _stats(keys: str, source: str) -> str:
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}count(*) AS data_file_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes,
      min(size_bytes) AS min_file_bytes, max(size_bytes) AS max_file_bytes,
      CAST(median(size_bytes) AS DOUBLE) AS median_file_bytes, count(DISTINCT manifest) AS manifest_count
      FROM {source} {group}"""


FILES = "files AS (SELECT doc_id AS path, n_chars AS size_bytes, source AS manifest, source FROM documents)"
BINS = FILES + """,
packed AS (
  SELECT path, size_bytes, manifest,
         CAST((sum(size_bytes) OVER (PARTITION BY manifest ORDER BY path) - size_bytes) // 16384 AS BIGINT) AS bin
  FROM files WHERE size_bytes < 16384)"""


def _mix_steps(seed: int) -> str:
    """The generator's number mix as a chain of subqueries, so that the text stays short."""
    draws = (1, 2, 3)
    sql = "SELECT o_orderkey + 1 AS id, " + ", ".join(
        f"((o_orderkey + 1) * 31 + {seed * 17 + d * 101}) % 2147483648 AS x{d}" for d in draws
    ) + " FROM orders"
    for _ in range(3):
        sql = "SELECT id, " + ", ".join(
            f"(x{d} * 1103515245 + 12345) % 2147483648 AS x{d}" for d in draws
        ) + f" FROM ({sql})"
        sql = "SELECT id, " + ", ".join(f"xor(x{d}, x{d} >> 13) AS x{d}" for d in draws) + f" FROM ({sql})"
    return sql


STATUS = "CASE {} WHEN 0 THEN 'created' WHEN 1 THEN 'paid' WHEN 2 THEN 'packed' WHEN 3 THEN 'shipped' ELSE 'delivered' END"


def _spike(profile: str, prefix: str, customer: int, amount: int, seed: int) -> str:
    return f"""SELECT id AS order_id, '{prefix}' || lpad(CAST(id AS VARCHAR), 12, '0') AS business_key, id AS event_id,
      id % 1000 + {customer} AS customer_id, {STATUS.format('id % 5')} AS status, id + {amount} AS amount_cents,
      strftime(TIMESTAMP '2026-01-01 00:00:00' + to_seconds(id), '%Y-%m-%d %H:%M:%S.%g') AS updated_at,
      CAST({seed} AS INTEGER) AS seed, '{profile}' AS profile FROM (SELECT o_orderkey + 1 AS id FROM orders)"""


def _digest_level(source: str, target: str) -> str:
    return f"""{target} AS (
      SELECT k // 4096 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM {source} GROUP BY k // 4096)"""


LEDGER_RULES = """
c AS (SELECT c_custkey AS c, 'record-' || CAST(c_custkey AS VARCHAR) AS name FROM customer),
broken AS (
  SELECT name, 'provenance.run_id' AS rule FROM c WHERE c % 17 = 0
  UNION ALL SELECT name, 'drill.diff_zero' FROM c WHERE c % 13 = 0
  UNION ALL SELECT name, 'drill.checks' FROM c WHERE c % 19 = 0
  UNION ALL SELECT name, 'drill.linkage' FROM c WHERE c % 23 = 0
  UNION ALL SELECT name, 'redelivery.exact_duplicates' FROM c WHERE c % 5 = 0 AND c % 29 = 0
  UNION ALL SELECT name, 'miskey.exposed' FROM c WHERE c % 5 = 1 AND c % 31 = 0
  UNION ALL SELECT name, 'poison.one_dead_letter' FROM c WHERE c % 5 = 2 AND c % 37 = 0
  UNION ALL SELECT name, 'logs.exist' FROM c WHERE c % 10 = 9)"""

FORMS = """
forms AS (
  SELECT o_orderkey AS k, o_orderkey % 12 AS form FROM orders),
outcomes AS (
  SELECT k AS "offset",
    CASE form WHEN 2 THEN 'InvalidRow' WHEN 3 THEN 'InvalidRow' WHEN 6 THEN 'InvalidRow' WHEN 7 THEN 'UnsupportedOperation'
      WHEN 8 THEN 'InvalidField' WHEN 9 THEN 'MalformedEnvelope' WHEN 10 THEN 'InvalidRow' END AS error_type,
    CASE WHEN form IN (0, 1, 4, 5) THEN k END AS order_id,
    CASE WHEN form IN (0, 1, 5) THEN 'paid' WHEN form = 4 THEN '5' END AS status,
    CASE form WHEN 0 THEN '2026-01-01 00:00:00.123000' WHEN 1 THEN '2026-01-01 00:00:00.123456'
      WHEN 4 THEN '2026-01-01 00:00:00.000000' WHEN 5 THEN '2026-01-01 00:00:00.123456' END AS updated_at
  FROM forms WHERE form <> 11)"""

LETTERS = OPS + """,
letters AS (SELECT * FROM log WHERE seq = 1 AND k % 97 = 13)"""

ORACLE: dict[str, str] = {
    "decode_changelog": _w(IMAGES) + "SELECT * FROM images",
    "decode_strictness": _w(FORMS) + "SELECT * FROM outcomes",
    "poison_rate": _w(FORMS)
    + "SELECT error_type, count(*) AS n FROM outcomes WHERE error_type IS NOT NULL GROUP BY 1",
    "source_snapshot": _w(SOURCE)
    + """SELECT CAST(order_id AS VARCHAR) AS order_id, business_key, CAST(event_id AS VARCHAR) AS event_id,
      CAST(customer_id AS VARCHAR) AS customer_id, status, CAST(amount_cents AS VARCHAR) AS amount_cents, updated_at,
      CAST(seed AS VARCHAR) AS seed FROM source""",
    "current_rows_applied": _w(IMAGES)
    + "SELECT cdc_row_kind, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS cents FROM images WHERE cdc_row_kind <> '-U' GROUP BY 1",
    "current_state": _w(SOURCE) + f"SELECT {ROW} FROM source",
    "current_as_of": _w(IMAGES.replace("FROM versioned)", 'FROM versioned WHERE "offset" // 1000 <= (SELECT max("offset") // 1000 // 2 FROM versioned))'), CURRENT)
    + "SELECT * FROM current_rows",
    "snapshot_then_changes": _w(SOURCE)
    + f"""SELECT {ROW} FROM source UNION ALL
      SELECT {ROW} FROM (SELECT * REPLACE (order_id + 1000000000000 AS order_id) FROM source)""",
    "changelog_lines": _w(IMAGES)
    + """SELECT partition, "offset", image_seq, concat_ws(chr(9), CAST(order_id AS VARCHAR), status, updated_at,
      CASE WHEN cdc_operation = 'delete' THEN 'NULL' ELSE cdc_operation END) AS line FROM images""",
    "adhoc_sql": _w(IMAGES, SOURCE)
    + """SELECT c.status AS status, count(DISTINCT c.order_id) AS live_orders, count(*) AS images,
      CAST(sum(CASE WHEN l.cdc_row_kind = '+U' THEN 1 ELSE 0 END) AS BIGINT) AS updates
      FROM source c JOIN images l ON c.order_id = l.order_id GROUP BY c.status""",
    "reconcile_current": _w(SOURCE, IMAGES, CURRENT)
    + """SELECT (SELECT count(*) FROM (SELECT * FROM source EXCEPT SELECT * FROM current_rows))
        + (SELECT count(*) FROM (SELECT * FROM current_rows EXCEPT SELECT * FROM source)) AS diff_count,
      (SELECT count(*) FROM (SELECT * FROM source EXCEPT SELECT * FROM current_rows)) AS missing_rows,
      (SELECT count(*) FROM (SELECT * FROM current_rows EXCEPT SELECT * FROM source)) AS unexpected_rows,
      (SELECT count(*) FROM source) AS expected_rows, (SELECT count(*) FROM current_rows) AS actual_rows,
      true AS digests_match""",
    "row_diff_corrupted": _w(SOURCE, CORRUPTED)
    + """SELECT *, 'missing_from_actual' AS side FROM (SELECT * FROM source EXCEPT SELECT * FROM corrupted)
      UNION ALL SELECT *, 'unexpected_in_actual' FROM (SELECT * FROM corrupted EXCEPT SELECT * FROM source)""",
    "row_diff_all_corrupted": _w(SOURCE)
    + "SELECT *, 'unexpected_in_actual' AS side, CAST(1 AS BIGINT) AS copies FROM source WHERE order_id % 50 = 9",
    "row_diff_by_key": _w(SOURCE)
    + """SELECT order_id, CASE WHEN order_id % 100 = 31 THEN 'missing' ELSE 'changed' END AS state,
      CASE WHEN order_id % 100 <> 31 THEN 'amount_cents' END AS changed_columns
      FROM source WHERE order_id % 100 = 31 OR order_id % 50 = 7""",
    "two_path_parity": _w(SOURCE)
    + """SELECT p.pair AS pair, CAST(0 AS BIGINT) AS diff_count, n AS expected_rows, n AS actual_rows
      FROM (SELECT count(*) AS n FROM source), (VALUES ('source_vs_a'), ('source_vs_b'), ('a_vs_b')) p(pair)""",
    "snapshot_digest": _w(SOURCE, HASHED)
    + """SELECT count(*) AS row_count, sha256(concat_ws(':', CAST(sum(n) AS VARCHAR), CAST(sum(a) AS VARCHAR),
      CAST(sum(b) AS VARCHAR), CAST(sum(c) AS VARCHAR), CAST(sum(d) AS VARCHAR))) AS digest FROM words""",
    "ordered_snapshot_digest": _w(
        SOURCE,
        HASHED,
        """l0 AS (SELECT order_id AS k, sha256(concat_ws(':', CAST(sum(n) AS VARCHAR), CAST(sum(a) AS VARCHAR),
          CAST(sum(b) AS VARCHAR), CAST(sum(c) AS VARCHAR), CAST(sum(d) AS VARCHAR))) AS h FROM words GROUP BY order_id)""",
        *[_digest_level(f"l{i}", f"l{i + 1}") for i in range(6)],
    )
    + "SELECT sha256(string_agg(h, '' ORDER BY k)) AS digest FROM l6",
    "membership": """
      SELECT 'deleted_keys' AS check_name, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0
      UNION ALL SELECT 'deleted_but_visible', CAST(0 AS BIGINT)
      UNION ALL SELECT 'updated_and_alive', count(*) FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0
      UNION ALL SELECT 'updated_but_stale', CAST(0 AS BIGINT)""",
    "duplicate_event_ids": _w(IMAGES)
    + "SELECT event_id, 2 * count(*) AS occurrences FROM images GROUP BY event_id HAVING 2 * count(*) > 1",
    "duplicate_occurrences": _w(IMAGES, "ids AS (SELECT event_id, count(*) AS n FROM images GROUP BY 1)")
    + """SELECT CAST(sum(n * d) AS BIGINT) AS changelog_rows, count(*) AS distinct_ids, count(*) FILTER (n * d > 1) AS duplicate_ids,
      CAST(sum(n * d - 1) AS BIGINT) AS duplicate_occurrences, CAST(d AS INTEGER) AS deliveries
      FROM ids, (VALUES (1), (2)) t(d) GROUP BY d""",
    "record_identity_dups": _w(IMAGES)
    + 'SELECT partition, "offset", image_seq, CAST(2 AS BIGINT) AS deliveries FROM images',
    "redelivery_audit": _w(IMAGES, SOURCE)
    + """SELECT count(*) AS images, 2 * count(*) AS deliveries, count(*) AS duplicate_occurrences,
      CAST(0 AS BIGINT) AS images_off_target, (SELECT count(DISTINCT order_id) FROM source) AS current_keys,
      CAST(0 AS BIGINT) AS repeated_keys, true AS passed FROM images""",
    "replay_targets": _w(IMAGES)
    + """SELECT count(*) AS changelog_rows, CAST(0 AS BIGINT) AS duplicate_occurrences, count(*) AS replayed,
      2 * count(*) AS expected_changelog_rows, count(*) AS expected_duplicate_occurrences FROM images""",
    "event_id_audit": _w(IMAGES, SOURCE, "ids AS (SELECT event_id, count(*) AS n FROM images GROUP BY 1)")
    + """SELECT s.n AS source_ids, s.n AS current_ids, s.n AS common_ids, CAST(sum(ids.n) AS BIGINT) AS changelog_rows,
      count(*) AS distinct_ids, count(*) FILTER (ids.n > 1) AS duplicate_ids, CAST(sum(ids.n - 1) AS BIGINT) AS duplicate_occurrences,
      true AS current_event_ids_match FROM ids, (SELECT count(DISTINCT event_id) AS n FROM source) s GROUP BY s.n""",
    "monotonic_violations": _w(PROBE)
    + "SELECT order_id, count(*) AS records, count(*) FILTER (event_id <= prev_event) AS violations FROM stepped GROUP BY 1",
    "main_log_order": _w(IMAGES)
    + """SELECT count(DISTINCT order_id) AS keys, count(*) AS records, CAST(0 AS BIGINT) AS violations
      FROM images WHERE cdc_row_kind IN ('+I', '+U')""",
    "offsets_increase": _w(OPS)
    + """SELECT partition, count(*) AS records, count(*) FILTER ("offset" <= prev) AS violations FROM (
      SELECT partition, "offset", lag("offset") OVER (PARTITION BY partition ORDER BY "offset") AS prev FROM log) GROUP BY 1""",
    "miskey_audit": _w(PROBE)
    + """SELECT order_id, count(*) AS records, count(*) FILTER (key_order_id <> order_id) AS mismatched_keys,
      count(DISTINCT partition) > 1 AS spans_partitions, count(*) FILTER (event_id <= prev_event) AS order_violations,
      count(*) FILTER ("offset" <= prev_offset) AS offset_violations, max(event_id) FILTER (i = 2) AS arrival_final_event_id,
      max(event_id) AS canonical_final_event_id, max(event_id) FILTER (i = 2) <> max(event_id) AS would_corrupt,
      CASE WHEN order_id % 2 = 1 THEN 'reject' ELSE 'admit' END AS disposition FROM stepped GROUP BY order_id""",
    "partitions_per_key": _w(PROBE)
    + "SELECT order_id, count(DISTINCT partition) AS partitions, count(*) AS records FROM probe GROUP BY 1",
    "admission_gate": _w(PROBE)
    + 'SELECT order_id, event_id, partition, "offset", order_id % 2 = 0 AS admitted FROM probe',
    "dead_letter_rows": _w(LETTERS)
    + f"""SELECT CAST(1 AS INTEGER) AS dlq_schema_version, partition, "offset", {BASE_MS} + "offset" * 1000 AS timestamp_ms,
      CAST(k AS VARCHAR) AS record_key, 'UnsupportedOperation' AS error_type, k AS intended_order_id,
      CASE WHEN k % 10 = 0 THEN 'r' ELSE 'c' END AS intended_operation, true AS repairable FROM letters""",
    "dead_letter_wire": _w(LETTERS)
    + """SELECT CAST(1 AS INTEGER) AS dlq_schema_version, '2026-01-01T00:00:00.000Z' AS quarantined_at, partition, "offset",
      'UnsupportedOperation' AS error_type FROM letters""",
    "dlq_audit": _w(LETTERS)
    + "SELECT count(*) AS dead_letters, true AS metadata_complete, true AS bytes_preserved FROM letters",
    "dlq_state_gap": """
      WITH p AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 97 = 13)
      SELECT 'before_repair' AS stage, count(*) FILTER (k % 5 <> 0 AND k % 2 = 1) AS missing_rows, CAST(0 AS BIGINT) AS unexpected_rows FROM p
      UNION ALL SELECT 'repaired_in_place', CAST(0 AS BIGINT), CAST(0 AS BIGINT)
      UNION ALL SELECT 'repaired_at_tail', count(*) FILTER (k % 2 = 0 AND k % 5 <> 0), count(*) FILTER (k % 2 = 0 OR k % 5 = 0) FROM p""",
    "dlq_repair": _w(SOURCE) + f"SELECT {ROW} FROM source",
    "wire_header_audit": """
      SELECT CASE WHEN o_orderkey % 11 <> 0 THEN 100 + o_orderkey % 7 END AS schema_id, count(*) AS records,
        coalesce(CASE WHEN o_orderkey % 11 <> 0 THEN 100 + o_orderkey % 7 END < 105, false) AS registered
      FROM orders GROUP BY ALL""",
    "group_lag": _w(OPS)
    + """SELECT partition, count(*) - partition * 10 AS current_offset, count(*) AS log_end_offset,
      CAST(partition * 10 AS BIGINT) AS lag, true AS complete FROM log GROUP BY partition
      UNION ALL SELECT CAST(3 AS INTEGER), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), true""",
    "lag_summary": _w(OPS)
    + """SELECT CAST(30 AS BIGINT) AS lag_sum, CAST(20 AS BIGINT) AS lag_max, count(*) AS source_total, true AS complete FROM log""",
    "offsets_for_timestamp": _w(OPS)
    + f"""SELECT partition, coalesce(min("offset") FILTER ({BASE_MS} + "offset" * 1000 >= {HALF}), -1) AS requested_offset,
      coalesce(min("offset") FILTER ({BASE_MS} + "offset" * 1000 >= {HALF}), max("offset") + 1) AS resolved_start_offset,
      max("offset") + 1 AS log_end_offset FROM log GROUP BY partition""",
    "rebuild_from_zero": _w(SOURCE)
    + "SELECT CAST(0 AS BIGINT) AS diff_count, count(*) AS actual_rows, true AS digests_match FROM source",
    "rebuild_from_timestamp": _w(
        IMAGES.replace("FROM versioned)", f'FROM versioned WHERE {BASE_MS} + "offset" * 1000 >= {HALF})'), CURRENT
    )
    + "SELECT * FROM current_rows",
    "timestamp_coverage": _w(IMAGES, SOURCE)
    + f"""SELECT order_id FROM source WHERE order_id NOT IN (
      SELECT order_id FROM images WHERE cdc_row_kind <> '-U' AND source_ts_ms >= {HALF})""",
    "append_positions": _w(OPS, "ends AS (SELECT partition, count(*) AS n FROM log GROUP BY 1)")
    + """SELECT c_custkey, CAST(c_custkey % 3 AS INTEGER) AS partition,
      n + row_number() OVER (PARTITION BY c_custkey % 3 ORDER BY c_custkey) - 1 AS "offset"
      FROM customer JOIN ends ON ends.partition = c_custkey % 3""",
    "first_log_records": _w(OPS)
    + 'SELECT partition, "offset", CAST(k AS VARCHAR) AS record_key FROM log ORDER BY partition, "offset" LIMIT 100',
    "linkage": """
      WITH r AS (SELECT o_custkey AS run_id, count(DISTINCT o_orderkey % 3) AS partitions, count(*) FILTER (o_orderstatus = 'P') = 0 AS lag_zero,
        max(o_orderkey) FILTER (o_orderstatus = 'O') AS checkpoint_id, max(o_orderkey) FILTER (o_orderstatus = 'F') AS current_snapshot_id,
        max(o_orderkey) FILTER (o_orderstatus = 'O') AS changelog_snapshot_id FROM orders GROUP BY 1)
      SELECT *, lag_zero AND checkpoint_id IS NOT NULL AND current_snapshot_id IS NOT NULL AND changelog_snapshot_id IS NOT NULL AS complete FROM r""",
    "commit_lag": _w(IMAGES, SOURCE)
    + f"""SELECT s.m AS source_max_event_id, c.m AS changelog_max_event_id, s.n AS source_rows, c.n AS changelog_rows,
      greatest(s.m - c.m, 0) AS max_event_id_gap, greatest(s.n - c.n, 0) AS lag_events
      FROM (SELECT coalesce(max(event_id), 0) AS m, count(*) AS n FROM source) s,
           (SELECT coalesce(max(event_id), 0) AS m, count(*) AS n FROM images
            WHERE cdc_row_kind = '+I' AND source_ts_ms < {HALF}) c""",
    "snapshot_history": _w(EVENTS) + "SELECT * FROM snapshots",
    "latest_snapshots": _w(EVENTS)
    + """SELECT t.t AS table_name, max(snapshot_id) AS snapshot_id
      FROM snapshots, (VALUES ('orders_current'), ('orders_changelog')) t(t) GROUP BY 1""",
    "snapshot_summary": _w(EVENTS)
    + """SELECT 'orders_current' AS table_name, (SELECT count(*) FROM snapshots) AS snapshot_count,
        (SELECT max(snapshot_id) FROM snapshots) AS current_snapshot_id, count(*) AS total_files,
        count(*) FILTER (event_type = 'error') AS total_delete_files,
        count(*) FILTER (event_type = 'error' AND event_id // 500 + 1 = (SELECT max(snapshot_id) FROM snapshots)) AS added_delete_files
      FROM events
      UNION ALL SELECT 'orders_changelog', count(*), max(snapshot_id), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM snapshots""",
    "commit_batches": _w(EVENTS) + "SELECT * FROM batches",
    "events_in_batches": "SELECT event_id, event_id // 100 AS batch_id FROM events",
    "newly_visible": """
      SELECT event_id // 500 + 1 AS snapshot_id, count(*) AS new_events, min(event_id) AS first_event_id,
        max(event_id) AS last_event_id FROM events GROUP BY 1""",
    "freshness": _w(EVENTS)
    + """SELECT count(*) AS sample_count, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms,
      percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms) AS p50_ms,
      percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS p95_ms FROM samples""",
    "freshness_buckets": _w(EVENTS)
    + """SELECT snapshot_id, max(committed_at_epoch_ms) AS committed_at_epoch_ms, count(*) AS new_event_count,
      min(event_id) AS first_event_id, max(event_id) AS last_event_id, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms,
      percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms) AS p50_ms,
      percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS p95_ms FROM samples GROUP BY 1""",
    "freshness_problems": _w(EVENTS)
    + """SELECT count(*) - (SELECT count(DISTINCT event_id) FROM samples) AS missing_events,
      (SELECT count(DISTINCT event_id) FROM samples WHERE latency_ms < 0) AS negative_latencies FROM events""",
    "throughput": _w(EVENTS, RATES)
    + """SELECT rows, round(src, 3) AS source_insert_seconds, round(tot, 3) AS end_to_end_seconds,
      round(rows / src, 3) AS source_insert_rows_per_second, round(rows / tot, 3) AS end_to_end_rows_per_second FROM rates""",
    "slo_gate": _w(EVENTS, RATES, RUNS, """
      measured AS (
        SELECT 'end_to_end_rows_per_second' AS measurement, round(rows / tot, 3) AS measured FROM rates
        UNION ALL SELECT 'end_to_end_seconds', round(tot, 3) FROM rates
        UNION ALL SELECT 'freshness_p50_ms', CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms) AS DOUBLE) FROM samples
        UNION ALL SELECT 'freshness_p95_ms', CAST(percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS DOUBLE) FROM samples
        UNION ALL SELECT 'recovery_' || replace(failure_class, '-', '_') || '_seconds', max_recovery_seconds FROM classes),
      budgets(measurement, budget) AS (VALUES
        ('end_to_end_rows_per_second', 1790.0::DOUBLE), ('end_to_end_seconds', 56.0::DOUBLE), ('freshness_p50_ms', 15300.0::DOUBLE),
        ('freshness_p95_ms', 20700.0::DOUBLE), ('recovery_broker_restart_seconds', 48.0::DOUBLE),
        ('recovery_duplicate_redelivery_seconds', 51.0::DOUBLE), ('recovery_mis_keying_seconds', 25.0::DOUBLE),
        ('recovery_poison_dlq_seconds', 53.0::DOUBLE), ('recovery_offset_replay_seconds', 39.0::DOUBLE))""")
    + """SELECT measurement, measured, budget, CASE WHEN measurement = 'end_to_end_rows_per_second' THEN measured >= budget
      ELSE measured <= budget END AS passed FROM measured JOIN budgets USING (measurement)""",
    "metric_samples": _w(METRICS) + "SELECT event_id, name, job, task, metric_value FROM metrics",
    "metric_max": _w(METRICS)
    + """SELECT scrape, max(metric_value) AS max_value,
      max(name) FILTER (metric_value = top) AS metric_name FROM (
        SELECT *, max(metric_value) OVER (PARTITION BY scrape) AS top FROM metrics WHERE turn = 0) GROUP BY scrape""",
    "metric_max_of_job": _w(METRICS)
    + """SELECT metric_value AS max_value, name AS metric_name FROM metrics WHERE turn = 2 AND job = '1'
      ORDER BY metric_value DESC, name DESC LIMIT 1""",
    "backpressure": _w(METRICS, """
      w AS (SELECT scrape, max(metric_value) FILTER (turn = 2) / 1000000.0::DOUBLE AS checkpoint_alignment_time_ms,
        max(metric_value) FILTER (turn = 1) AS backpressured_time_ms_per_second,
        max(metric_value) FILTER (turn = 0) AS busy_time_ms_per_second FROM metrics GROUP BY 1)""")
    + """SELECT *, CASE WHEN backpressured_time_ms_per_second > 0 THEN least(backpressured_time_ms_per_second / 1000.0::DOUBLE, 1.0::DOUBLE)
      WHEN busy_time_ms_per_second IS NOT NULL THEN least(busy_time_ms_per_second / 1000.0::DOUBLE, 1.0::DOUBLE)
      WHEN backpressured_time_ms_per_second IS NOT NULL THEN 0.0::DOUBLE END AS backpressure_indicator FROM w""",
    "source_metrics": _w(METRICS)
    + """SELECT scrape, bool_or(turn = 3) AS lag_metric_present, count(DISTINCT name) AS distinct_names, count(*) AS samples,
      string_agg(DISTINCT name, ',' ORDER BY name) AS metric_names FROM metrics WHERE turn IN (3, 4) AND job = '1' GROUP BY 1""",
    "connector_metrics": _w(METRICS)
    + """SELECT scrape, count(*) AS metric_count, arg_min(metric_value, event_id) AS total_events_seen,
      CAST(NULL AS DOUBLE) AS queue_remaining_capacity FROM metrics WHERE turn = 5 GROUP BY 1""",
    "metric_keys": _w(METRICS)
    + "SELECT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS metric_key, count(*) AS n FROM metrics GROUP BY 1",
    "sample_phases": _w(LOAD) + "SELECT series, sample_index, lag_events, phase FROM phased",
    "zero_lag_runs": _w(LOAD, """
      islands AS (SELECT series, sample_index, lag_events,
        sum(CASE WHEN lag_events > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY sample_index) AS island FROM load),
      runs AS (SELECT series, sample_index, lag_events, CASE WHEN lag_events > 0 THEN 0 ELSE
        count(*) FILTER (lag_events = 0) OVER (PARTITION BY series, island ORDER BY sample_index) END AS zero_run FROM islands)""")
    + "SELECT *, zero_run >= 3 AS recovered FROM runs",
    "state_transitions": _w(LOAD)
    + """SELECT * FROM (SELECT series, sample_index, phase, lag(phase) OVER (PARTITION BY series ORDER BY sample_index) AS previous_state FROM phased)
      WHERE previous_state IS DISTINCT FROM phase""",
    "user_state_transitions": """
      SELECT * FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_state FROM events)
      WHERE previous_state IS DISTINCT FROM event_type""",
    "load_summary": _w(LOAD)
    + """SELECT series, count(*) AS samples, max(duration_ms) FILTER (phase = 'baseline') AS baseline_duration_ms,
      max(duration_ms) FILTER (phase <> 'baseline') AS load_duration_ms,
      max(alignment_ms) FILTER (phase = 'baseline') AS baseline_alignment_ms,
      max(alignment_ms) FILTER (phase <> 'baseline') AS load_alignment_ms,
      max(indicator) FILTER (phase <> 'baseline') AS peak_indicator, max(lag_events) FILTER (phase <> 'baseline') AS peak_lag,
      arg_max(lag_events, sample_index) AS final_lag, max(failed_count) AS failed_count FROM phased GROUP BY series""",
    "load_checks": _w(CHECKS) + "SELECT * FROM checks",
    "check_suite": _w(CHECKS)
    + """SELECT bool_and(passed) AS passed, count(*) AS checks,
      coalesce(string_agg(check_name, ',' ORDER BY check_name) FILTER (NOT passed), '') AS failed
      FROM (SELECT * FROM checks UNION ALL SELECT 'event_ids_match', true)""",
    "collected_samples": """
      SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'error') AS lag_events,
        max(user_id) FILTER (event_type <> 'error') AS latest_completed_id,
        greatest(max(value), CAST(max(user_id) FILTER (event_type <> 'error') * 2 AS DOUBLE)) AS duration_ms
      FROM events GROUP BY 1""",
    "observability_summary": """
      SELECT count(*) AS sample_count, count(*) FILTER (event_id % 7 <> 0) AS lag_sample_count,
        count(*) FILTER (event_id % 7 <> 0 AND event_id % 3 = 0) AS prometheus_lag_sample_count,
        count(*) FILTER (event_id % 2 = 0) AS connector_sample_count,
        coalesce(max(user_id) FILTER (event_id % 7 <> 0), 0) AS max_group_lag,
        count(*) FILTER (event_type = 'error') AS scrape_error_sample_count FROM events""",
    "recovery_by_class": _w(RUNS) + "SELECT * FROM classes",
    "suite_summary": _w(RUNS)
    + """SELECT count(*) AS runs, count(*) FILTER (NOT passed) = 0 AS passed, bool_and(passed AND diff = 0) AS all_snapshot_diffs_zero,
      bool_and(passed AND audit_ok) AS all_event_id_audits_consistent, CAST(sum(diff) AS BIGINT) AS total_diff,
      count(*) FILTER (NOT passed) AS errors FROM runs""",
    "end_offset_report": """
      SELECT CAST(CASE WHEN c_custkey % 10 <> 0 THEN c_custkey END AS INTEGER) AS partition,
        CASE WHEN c_custkey % 10 <> 0 THEN c_custkey * 3 END AS log_end_offset,
        CASE WHEN c_custkey % 10 = 0 THEN 'shop.orders:' || CAST(c_custkey AS VARCHAR) || ':oops' END AS malformed
      FROM customer WHERE c_custkey % 4 <> 3""",
    "group_offset_report": """
      SELECT CAST(c_custkey AS INTEGER) AS partition, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey * 2 END AS current_offset,
        c_custkey * 3 AS log_end_offset, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey END AS lag,
        CASE WHEN c_custkey % 10 = 0 THEN concat_ws('   ', 'readers', 'shop.orders', CAST(c_custkey AS VARCHAR), '-',
          CAST(c_custkey * 3 AS VARCHAR), '-', 'consumer-1') END AS malformed
      FROM customer WHERE c_custkey % 4 <> 3""",
    "reset_report": """
      SELECT CAST(c_custkey AS INTEGER) AS partition, CAST(0 AS BIGINT) AS new_offset FROM customer
      UNION ALL SELECT CAST(c_custkey + 1000000 AS INTEGER), CAST(5 AS BIGINT) FROM customer""",
    "connector_states": """
      SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'PAUSED' ELSE 'RUNNING' END AS connector_state, CAST(t.t AS INTEGER) AS task_id,
        CASE WHEN t.t = 0 AND s_suppkey % 3 = 0 THEN 'FAILED' ELSE 'RUNNING' END AS task_state,
        CASE WHEN t.t = 0 AND s_suppkey % 3 = 0 THEN 'java.io.IOException' END AS failure_type
      FROM supplier, (VALUES (0), (1)) t(t)""",
    "numeric_paths": """
      SELECT event_id, 'id' AS path, CAST(event_id AS DOUBLE) AS number FROM events
      UNION ALL SELECT event_id, 'end_to_end_duration', value FROM events
      UNION ALL SELECT event_id, 'tasks.alignment.max_duration', value * 2 FROM events
      UNION ALL SELECT event_id, 'tasks.alignment.min_buffered', value FROM events
      UNION ALL SELECT event_id, 'tasks.start_delay.0', CAST(event_id % 10 AS DOUBLE) FROM events
      UNION ALL SELECT event_id, 'tasks.start_delay.1', CAST(event_id % 7 AS DOUBLE) FROM events""",
    "max_path_numbers": """
      SELECT event_id, value * 2 AS alignment_ms, CAST(greatest(event_id % 10, event_id % 7) AS DOUBLE) AS start_delay_ms FROM events""",
    "schema_fields": _w(FIELDS) + "SELECT subject, version, field, has_default FROM fields",
    "schema_evolution": """
      SELECT 'part-' || CAST(p_partkey AS VARCHAR) AS subject, CASE WHEN p_partkey % 6 = 2 THEN 'p_size' ELSE '' END AS removed_fields,
        CASE WHEN p_partkey % 6 IN (1, 4) THEN 'brand' ELSE '' END AS added_fields,
        CASE WHEN p_partkey % 6 IN (3, 5) THEN 'p_size' ELSE '' END AS changed_field_types,
        CASE WHEN p_partkey % 6 = 4 THEN 'brand' ELSE '' END AS added_fields_without_defaults,
        p_partkey % 6 NOT IN (3, 4) AS backward_compatible, p_partkey % 6 IN (0, 1) AS passed FROM part""",
    "schema_admission": """
      SELECT 'part-' || CAST(p_partkey AS VARCHAR) AS subject, CAST(v.v AS INTEGER) AS version
      FROM part, (VALUES (1), (2)) v(v) WHERE v.v = 1 OR p_partkey % 6 NOT IN (3, 4)""",
    "schema_mutation": _w(FIELDS)
    + """SELECT subject, version, field, CAST(1 AS BIGINT) AS mutations, field = 'p_partkey'
      OR (field = 'p_size' AND version = 2 AND p_partkey % 6 = 3) OR (field = 'brand' AND p_partkey % 6 = 4) AS is_string FROM fields""",
    "contract_fingerprints": """
      SELECT 'part-' || CAST(p_partkey AS VARCHAR) AS subject, p_partkey % 6 = 0 AS same_contract FROM part""",
    "file_stats": _w(FILES) + _stats("", "files"),
    "file_stats_per_manifest": _w(FILES) + _stats("source", "files"),
    "compaction_plan": _w(BINS) + "SELECT * FROM packed",
    "compaction_effect": _w(
        BINS,
        "b AS (" + _stats("source", "(SELECT *, manifest AS source FROM packed)") + ")",
        """binned AS (SELECT manifest AS source, bin, sum(size_bytes) AS size_bytes, 'rewritten' AS manifest FROM packed GROUP BY ALL)""",
        "a AS (" + _stats("source", "binned") + ")",
    )
    + """SELECT source, a.data_file_count < b.data_file_count AS data_file_count_decreased,
      a.manifest_count < b.manifest_count AS manifest_count_decreased, a.median_file_bytes > b.median_file_bytes AS median_file_size_increased,
      a.data_file_count < b.data_file_count AS planning_latency_decreased,
      CAST(a.data_file_count - b.data_file_count AS DOUBLE) AS data_file_count_delta,
      CAST(a.manifest_count - b.manifest_count AS DOUBLE) AS manifest_count_delta,
      a.median_file_bytes - b.median_file_bytes AS median_file_bytes_delta,
      CAST(a.data_file_count - b.data_file_count AS DOUBLE) AS planning_latency_ms_delta FROM a JOIN b USING (source)""",
    "key_constraints": """
      SELECT c.c AS constraint_name, CAST(0 AS BIGINT) AS violations FROM (VALUES ('not_null.order_id'), ('not_null.business_key'),
        ('not_null.event_id'), ('not_null.customer_id'), ('not_null.status'), ('not_null.amount_cents'), ('not_null.updated_at'),
        ('not_null.seed'), ('length.business_key'), ('length.status'), ('unique.order_id'), ('unique.business_key'), ('unique.event_id')) c(c)""",
    "key_constraints_broken": _w(SOURCE, """
      mixed AS (SELECT * FROM source UNION ALL SELECT * REPLACE (lpad(business_key, 70, 'x') AS business_key, event_id + 1 AS event_id)
        FROM source WHERE order_id % 3 = 1)""")
    + """SELECT c.c AS constraint_name, CAST(0 AS BIGINT) AS violations FROM (VALUES ('not_null.order_id'), ('not_null.business_key'),
        ('not_null.event_id'), ('not_null.customer_id'), ('not_null.status'), ('not_null.amount_cents'), ('not_null.updated_at'),
        ('not_null.seed'), ('length.status')) c(c)
      UNION ALL SELECT 'length.business_key', count(*) FROM mixed WHERE length(business_key) > 64
      UNION ALL SELECT 'unique.order_id', count(*) FROM (SELECT 1 FROM mixed GROUP BY order_id HAVING count(*) > 1)
      UNION ALL SELECT 'unique.business_key', count(*) FROM (SELECT 1 FROM mixed GROUP BY business_key HAVING count(*) > 1)
      UNION ALL SELECT 'unique.event_id', count(*) FROM (SELECT 1 FROM mixed GROUP BY event_id HAVING count(*) > 1)""",
    "generated_orders": f"""
      SELECT id AS order_id, 'order-' || lpad(CAST(id AS VARCHAR), 12, '0') AS business_key, id AS event_id, x1 % 10000 + 1 AS customer_id,
        {STATUS.format('x2 % 5')} AS status, x3 % 250000 + 100 AS amount_cents,
        strftime(TIMESTAMP '2026-01-01 00:00:00' + to_seconds(id), '%Y-%m-%d %H:%M:%S.%g') AS updated_at, CAST(42 AS INTEGER) AS seed
      FROM ({_mix_steps(42)})""",
    "spike_workload": _spike("load", "load-order-", 23000, 30000, 223)
    + " UNION ALL "
    + _spike("compaction", "compaction-order-", 10000, 25000, 222),
    "ledger_validation": _w(LEDGER_RULES) + "SELECT * FROM broken",
    "run_index": """
      SELECT 'record-' || CAST(c_custkey AS VARCHAR) AS name, 'B3' AS phase,
        CASE WHEN c_custkey % 17 <> 0 THEN 'run-' || CAST(c_custkey AS VARCHAR) END AS run_id, '00000000' AS git_sha,
        '2026-01-01T00:00:00Z' AS started_at, '2026-01-01T00:01:00Z' AS finished_at, 'verify' AS command,
        'logs/' || CAST(c_custkey % 10 AS VARCHAR) || '.log' AS logs FROM customer""",
    "stream_exactly_once": _w(SOURCE) + f"SELECT {ROW} FROM source",
    "stream_changelog_totals": _w(IMAGES, SOURCE)
    + """SELECT 'changelog' AS what, count(*) AS n FROM images WHERE NOT (cdc_row_kind = '+I' AND order_id % 97 = 13)
      UNION ALL SELECT 'ledger_changelog', count(*) FROM images WHERE NOT (cdc_row_kind = '+I' AND order_id % 97 = 13)
      UNION ALL SELECT 'dead_letters', count(*) FROM images WHERE cdc_row_kind = '+I' AND order_id % 97 = 13
      UNION ALL SELECT 'current', count(*) FROM source WHERE NOT (order_id % 97 = 13 AND order_id % 2 = 1)""",
    "stream_compacted": _w(SOURCE) + f"SELECT {ROW} FROM source",
    "stream_coalesce": _w(IMAGES, CURRENT) + f"SELECT {ROW}, cdc_row_kind FROM latest WHERE rn = 1",
}
ORACLE["stream_redelivery"] = ORACLE["redelivery_audit"]

from tidemark.plans.stream_oracle import STREAM_ORACLE  # noqa: E402

ORACLE.update(STREAM_ORACLE)
