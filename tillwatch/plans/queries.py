"""One named query per operator, with the SQL that gives the same rows."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed_values as fv
from ..operators import admission, dedup, joins, lookups, reports, rules, scoring, sessions, sketches
from ..operators import snapshots, storage, validation, velocity
from ..schemas import FRAUD_RESULTS, TRANSACTIONS
from ..session import new_table_path
from ..sources import frames, protobuf, replay
from ..sources import sample_data as sd
from . import oracles as o
from . import scoring_flow as flow

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}



def now():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")



def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def text(column: str):
    return F.concat_ws(",", column).alias(column)


# --- shared inputs ---------------------------------------------------------------


def vms_transactions(spark, sf):
    """Transactions on the compressed clock."""
    return sd.transactions(spark, sf).withColumn("ms", F.col("vms"))


def scored(spark, sf, answered=None):
    return flow.score_transactions(
        sd.transactions(spark, sf), sd.merchants(spark, sf), now(), clock_ms=F.col("vms"), answered=answered
    )


def stored_rows(spark, sf):
    return storage.to_stored(sd.decided(spark, sf), now())


# --- scans, sources, sinks -------------------------------------------------------


@query(
    "s01_txn_source",
    f"WITH {o.TX} SELECT card_hash, count(*) AS transactions, sum(amount_minor)::BIGINT AS amount_minor FROM tx GROUP BY ALL",
)
def s01(spark, sf):
    txns = sd.transactions(spark, sf).select([f.name for f in TRANSACTIONS.fields])
    return txns.groupBy("card_hash").agg(
        F.count("*").alias("transactions"), F.sum("amount_minor").alias("amount_minor")
    )


@query(
    "s02_frame_triage",
    f"""WITH {o.FRAMES} SELECT part, event_id AS "offset", frame_reason AS reason,
    CASE WHEN frame_reason IS NULL THEN 7::BIGINT END AS schema_id,
    CASE WHEN frame_reason IS NULL THEN octet_length(encode(payload)) END AS payload_bytes FROM tri""",
)
def s02(spark, sf):
    return frames.triage(sd.raw_frames(spark, sf)).select(
        F.col("partition").alias("part"), "offset", "reason", "schema_id",
        F.octet_length("payload").alias("payload_bytes"),
    )


@query(
    "s03_payload_decode",
    f"""WITH {o.FRAMES} SELECT event_id AS "offset", reason,
    CASE WHEN reason IS NULL THEN txn_id END AS txn_id,
    CASE WHEN reason IS NULL THEN amount_minor END AS amount_minor,
    CASE WHEN reason IS NULL THEN event_type END AS triggered_rules FROM decoded""",
)
def s03(spark, sf):
    df = frames.decode(frames.triage(sd.raw_frames(spark, sf)), FRAUD_RESULTS)
    good = F.col("reason").isNull()
    return df.select(
        "offset", "reason",
        F.when(good, F.col("event.txn_id")).alias("txn_id"),
        F.when(good, F.col("event.amount_minor")).alias("amount_minor"),
        F.when(good, F.concat_ws(",", "event.triggered_rules")).alias("triggered_rules"),
    )


# the same records as messages: some are cut, and some have a field that readers do not know
@query(
    "s03_protobuf_decode",
    f"""WITH {o.FRAMES}, r AS (SELECT *, CASE WHEN event_id % 50 = 2 THEN reason || ': truncated' ELSE reason END AS why FROM decoded)
    SELECT event_id AS "offset", why AS reason, CASE WHEN reason IS NULL THEN txn_id END AS txn_id,
    CASE WHEN reason IS NULL THEN amount_minor END AS amount_minor, CASE WHEN reason IS NULL THEN currency END AS currency,
    CASE WHEN reason IS NULL THEN decision END AS decision, CASE WHEN reason IS NULL THEN risk_score END AS risk_score,
    CASE WHEN reason IS NULL THEN event_type END AS triggered_rules FROM r""",
)
def s03_protobuf(spark, sf):
    d = sd.decided(spark, sf).withColumn("triggered_rules", F.array("event_type"))
    columns = [c for c in protobuf.RESULT_FIELDS if c in d.columns]
    message = protobuf.encode(columns, protobuf.RESULT_FIELDS)
    d = d.select("event_id", message.alias("message"))
    payload = (
        F.when(F.expr("event_id % 50 = 2"), F.expr("substring(message, 1, length(message) - 1)"))
        .when(F.expr("event_id % 50 = 3"), F.concat("message", F.lit(protobuf.encoded({"x": 1}, {"x": 99}))))
        .otherwise(F.col("message"))
    )
    good = frames.frame(payload, sd.SCHEMA_ID)
    value = F.when(F.expr("event_id % 50 = 0"), F.lit(b"\x00\x01\x02")).when(F.expr("event_id % 50 = 1"), F.concat(F.lit(b"\x01"), good))
    framed = d.select(F.col("event_id").alias("offset"), value.otherwise(good).alias("value"))
    df = protobuf.decode(frames.triage(framed), FRAUD_RESULTS, protobuf.RESULT_FIELDS)
    # decoded once and stored, as an ingest does
    df = stored(spark, df.select("offset", "reason", "event"), "decoded")
    read = F.col("reason").isNull()
    return df.select(
        "offset", "reason",
        *[F.when(read, F.col(f"event.{c}")).alias(c) for c in ("txn_id", "amount_minor", "currency", "decision", "risk_score")],
        F.when(read, F.concat_ws(",", "event.triggered_rules")).alias("triggered_rules"),
    )


_MERCHANT_ROWS = f"""WITH {o.MERCHANTS} SELECT merchant_id, risk::DOUBLE AS risk_score, epoch_us(updated_at) // 1000 AS updated_ms
    FROM mer"""


def _merchant_rows(merchants):
    return merchants.select(
        "merchant_id", F.col("risk_score").cast("double").alias("risk_score"),
        F.unix_millis("updated_at").alias("updated_ms"),
    )


query("s04_merchant_dim", _MERCHANT_ROWS)(lambda spark, sf: _merchant_rows(sd.merchants(spark, sf)))
query("t01_newest_merchants", f"{_MERCHANT_ROWS} ORDER BY updated_at DESC, merchant_id LIMIT 25")(
    lambda spark, sf: _merchant_rows(joins.newest_merchants(sd.merchants(spark, sf), 25))
)


@query(
    "s05_rules_table",
    f"WITH {o.TX}, r(rule_id, points, fired) AS ("
    + " UNION ALL ".join(
        f"SELECT '{r['id']}', {r['score_contribution']}, count(CASE WHEN {o.RULE_SQL[r['id']]} THEN 1 END) FROM tx"
        for r in fv.RULES
    )
    + ") SELECT rule_id, points, fired FROM r",
)
def s05(spark, sf):
    table = rules.rule_table(spark).filter("enabled AND kind <> 'velocity'").select("rule_id", "points")
    txns = rules.with_rules(sd.transactions(spark, sf), now())
    fired = txns.select(F.explode("triggered_rules").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("fired"))
    return table.join(fired, "rule_id", "left").select("rule_id", "points", F.coalesce("fired", F.lit(0)).alias("fired"))


@query(
    "s06_result_publish",
    f"""WITH {o.DECIDED} SELECT card_hash AS key,
    '{{"txn_id":"' || txn_id || '","txn_timestamp":"' || txn_timestamp || '","card_hash":"' || card_hash ||
    '","masked_pan":"' || masked_pan || '","amount_minor":' || amount_minor || ',"currency":"' || currency ||
    '","merchant_id":"' || merchant_id || '","terminal_id":"' || terminal_id || '","mcc":"' || mcc ||
    '","transaction_type":' || transaction_type || ',"channel":' || channel || ',"scheme":' || scheme ||
    ',"rrn":"' || rrn || '","processed_at":"' || processed_at || '","decision":' || decision ||
    ',"risk_score":' || risk_score || ',"triggered_rules":[' ||
    CASE WHEN triggered_rules = '' THEN '' ELSE '"' || replace(triggered_rules, ',', '","') || '"' END || ']}}' AS value
    FROM dec""",
)
def s06(spark, sf):
    d = sd.decided(spark, sf)
    return frames.publish(flow.fraud_result_events(d, F.col("processed_at")))


_MONTHS = f"""{o.DECIDED},
st0 AS (SELECT *, ts + to_months((event_id % 40)::INT) AS mts FROM dec),
st AS MATERIALIZED (SELECT *, CASE WHEN strftime(mts, '%Y-%m') BETWEEN '{fv.FIRST_MONTH}' AND '{fv.LAST_MONTH}'
    THEN strftime(mts, '%Y-%m') ELSE '{fv.DEFAULT_MONTH}' END AS txn_month,
    {o.case('decision', fv.STATUS_LABELS, 'UNKNOWN')} AS status FROM st0)"""


def month_rows(spark, sf):
    """Stored rows spread over 40 months."""
    d = sd.decided(spark, sf).withColumn("mts", F.expr("ts + make_ym_interval(0, cast(event_id % 40 AS int))"))
    return storage.to_stored(d.withColumn("txn_timestamp", C.format_ts(F.col("mts"))), now())


@query(
    "s07_txn_table_write",
    f"WITH {_MONTHS} SELECT txn_month, count(*) AS n_rows, sum(amount_minor)::BIGINT AS amount_minor FROM st GROUP BY ALL",
)
def s07(spark, sf):
    return month_rows(spark, sf).groupBy("txn_month").agg(
        F.count("*").alias("n_rows"), F.sum("amount_minor").alias("amount_minor")
    )


# the table holds every transaction; all of them arrive again in another currency:
# sign-ups under a new id (inserts), failed ones twice with different scores
def upsert_sets(spark, sf):
    d = sd.decided(spark, sf)
    created = F.lit("2024-02-01 00:00:00").cast("timestamp")
    existing = storage.to_stored(d, created)
    again = (
        d.withColumn("txn_id", F.expr("if(event_type = 'signup', concat('n', txn_id), txn_id)"))
        .withColumn("currency", F.lit("XXX"))
        .withColumn("risk_score", F.expr("cast(100 + (event_id * 53) % 901 AS int)"))
        .withColumn("batch_seq", F.expr("event_id * 2"))
    )
    repeated = (
        again.filter("event_type = 'error'")
        .withColumn("risk_score", F.expr("cast(100 + (event_id * 71) % 901 AS int)"))
        .withColumn("batch_seq", F.expr("event_id * 2 + 1"))
    )
    incoming = again.unionByName(repeated).withColumn("decision", scoring.decide(F.col("risk_score")))
    return existing, storage.to_stored(incoming, now())


_STATUS = o.case("decision", fv.STATUS_LABELS, "UNKNOWN")
_MERGED = f"""{o.DECIDED},
writes AS (
  SELECT txn_id, txn_timestamp, currency, risk_score, {o.decide('risk_score')} AS decision, -1 AS seq, 1706745600000 AS written_ms FROM dec
  UNION ALL
  SELECT CASE WHEN event_type = 'signup' THEN 'n' || txn_id ELSE txn_id END, txn_timestamp, 'XXX',
    (100 + (event_id * 53) % 901)::INT, {o.decide('(100 + (event_id * 53) % 901)')}, event_id * 2, 1709251200000 FROM dec
  UNION ALL
  SELECT txn_id, txn_timestamp, 'XXX', (100 + (event_id * 71) % 901)::INT,
    {o.decide('(100 + (event_id * 71) % 901)')}, event_id * 2 + 1, 1709251200000 FROM dec WHERE event_type = 'error'),
merged AS (
  SELECT txn_id, txn_timestamp, arg_min(currency, seq) AS currency, arg_max(risk_score, seq) AS risk_score,
    arg_max(decision, seq) AS decision, arg_min(written_ms, seq) AS created_ms,
    CASE WHEN count(*) > 1 THEN 1709251200000 ELSE min(written_ms) END AS updated_ms
  FROM writes GROUP BY ALL)"""


def merged_rows(spark, sf):
    existing, incoming = upsert_sets(spark, sf)
    return storage.merge_rows(existing, incoming, now())


def merge_view(df):
    return df.select(
        "txn_id", C.format_ts(F.col("txn_timestamp")).alias("txn_timestamp"), "currency", "risk_score", "status",
        F.unix_millis("created_at").alias("created_ms"), F.unix_millis("updated_at").alias("updated_ms"),
    )


query(
    "s08_upsert",
    f"WITH {_MERGED} SELECT txn_id, txn_timestamp, currency, risk_score, {_STATUS} AS status, created_ms, updated_ms FROM merged",
)(lambda spark, sf: merge_view(merged_rows(spark, sf)))

query(
    "u01_existing_and_incoming",
    f"WITH {_MERGED} SELECT seq < 0 AS stored, count(*) AS n_rows FROM writes GROUP BY ALL",
)(
    lambda spark, sf: upsert_sets(spark, sf)[0]
    .withColumn("batch_seq", F.lit(-1).cast("long"))
    .unionByName(upsert_sets(spark, sf)[1])
    .groupBy((F.col("batch_seq") < 0).alias("stored"))
    .agg(F.count("*").alias("n_rows"))
)

query(
    "w10_last_write_wins",
    f"""WITH {_MERGED}, batch AS (SELECT txn_id, txn_timestamp, arg_min(currency, seq) AS currency,
    arg_max(risk_score, seq) AS risk_score FROM writes WHERE seq >= 0 GROUP BY ALL)
    SELECT txn_id, txn_timestamp, currency, risk_score, 1709251200000 AS updated_ms FROM batch""",
)(
    lambda spark, sf: merge_view(storage.merge_rows(None, upsert_sets(spark, sf)[1], now())).select(
        "txn_id", "txn_timestamp", "currency", "risk_score", "updated_ms"
    )
)


def quarantined(spark, sf):
    bad = frames.unreadable(frames.decode(frames.triage(sd.raw_frames(spark, sf)), FRAUD_RESULTS))
    return frames.to_quarantine(bad, F.timestamp_millis("event_ms"))


_QUARANTINE = f"""{o.FRAMES},
quar AS MATERIALIZED (SELECT *, strftime(make_timestamp(event_ms * 1000), '%Y-%m-%dT%H:%M:%SZ') AS failed_at
    FROM decoded WHERE reason IS NOT NULL)"""


@query(
    "s09_dlq_sink",
    f"""WITH {_QUARANTINE} SELECT card_hash AS key, lower(hex(value)) AS value, 'fraud_results' AS dlq_original_topic,
    part::VARCHAR AS dlq_original_partition, event_id::VARCHAR AS dlq_original_offset,
    reason AS dlq_failure_reason, '0' AS dlq_retry_count, failed_at AS dlq_failed_at FROM quar""",
)
def s09(spark, sf):
    return quarantined(spark, sf).withColumns({"key": F.col("key").cast("string"), "value": F.lower(F.hex("value"))})


def with_uuids(rows):
    """Ids as the service assigns them, one row in 41 excepted."""
    return rows.withColumn(
        "txn_id", F.when(F.expr("event_id % 41 = 0"), F.col("txn_id")).otherwise(C.txn_id_for(F.col("txn_id"), F.col("event_ms")))
    )


def uuid_frames(spark, sf):
    return sd.raw_frames(spark, sf, with_uuids)


UUID_SQL = """CASE WHEN event_id % 41 = 0 THEN txn_id ELSE regexp_replace(sha256(txn_id || '|' || event_ms),
    '^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$', '\\1-\\2-4\\3-a\\4-\\5') END"""


# every frame was quarantined after failed writes; purchases had been stored before
def replayable(spark, sf):
    all_frames = uuid_frames(spark, sf).withColumn("reason", F.lit(frames.batch_failure_reason("timeout")))
    quarantine = frames.to_quarantine(all_frames, F.timestamp_millis("event_ms"), fv.MAX_ATTEMPTS)
    before = storage.to_stored(with_uuids(sd.decided(spark, sf)).filter("event_type = 'purchase'"), now())
    return quarantine, before


_REPLAY = f"""WITH {o.FRAMES} SELECT {UUID_SQL} AS txn_id, txn_timestamp, risk_score, {_STATUS} AS status,
    '["' || event_type || '"]' AS triggered_rules FROM decoded
    WHERE reason IS NULL AND event_id % 41 <> 0 AND event_type <> 'purchase'"""


@query("s10_dlq_replay", _REPLAY)
def s10(spark, sf):
    return replay.replay_rows(*replayable(spark, sf), now()).select(
        "txn_id", C.format_ts(F.col("txn_timestamp")).alias("txn_timestamp"), "risk_score", "status", "triggered_rules"
    )


@query(
    "s10_dlq_rejects",
    f"""WITH {o.FRAMES} SELECT event_id::VARCHAR AS dlq_original_offset,
    coalesce(reason, 'constraint_violation: txn_id is not a uuid') AS dlq_failure_reason, '4' AS dlq_retry_count
    FROM decoded WHERE reason IS NOT NULL OR event_id % 41 = 0""",
)
def s10_rejects(spark, sf):
    quarantine, _ = replayable(spark, sf)
    return replay.still_rejected(quarantine, now()).select("dlq_original_offset", "dlq_failure_reason", "dlq_retry_count")


# --- validation and projections --------------------------------------------------

_V_IDS = {name: f"v{i:02d}_{name}" for i, name in enumerate(o.CHECK_SQL, 1)}

for _name, _id in _V_IDS.items():
    _bad, _msg = o.CHECK_SQL[_name]

    def _check(spark, sf, name=_name):
        bad, message = validation.request_checks()[name]
        return sd.requests(spark, sf).filter(bad).select("event_id", message.alias("message"))

    query(_id, f"WITH {o.REQ} SELECT event_id, {_msg} AS message FROM req WHERE {_bad}")(_check)


@query(
    "v11_validate",
    f"""WITH {o.REQ}, e AS (SELECT event_id, {o.ERRORS} AS errors FROM req)
    SELECT event_id, CASE WHEN errors <> '' THEN 'validation failed: ' || errors END AS error FROM e""",
)
def v11(spark, sf):
    return validation.with_failures(sd.requests(spark, sf)).select("event_id", "error")


@query(
    "v12_validate_split",
    f"""WITH {o.REQ}, e AS (SELECT client_id, amount_minor, {o.ERRORS} = '' AS accepted FROM req)
    SELECT client_id, accepted, count(*) AS requests, sum(amount_minor)::BIGINT AS amount_minor FROM e GROUP BY ALL""",
)
def v12(spark, sf):
    checked = validation.with_failures(sd.requests(spark, sf))
    good = validation.accepted(checked).select("client_id", "amount_minor", F.lit(True).alias("accepted"))
    bad = validation.rejected(checked).select("client_id", "amount_minor", F.lit(False).alias("accepted"))
    return good.unionByName(bad).groupBy("client_id", "accepted").agg(
        F.count("*").alias("requests"), F.sum("amount_minor").alias("amount_minor")
    )


def spoiled_rows(spark, sf):
    """Stored rows that break constraints in different ways."""
    d = sd.decided(spark, sf)
    key = F.concat(F.lit("ik-"), F.col("event_id").cast("string"))
    rows = storage.to_stored(
        d.withColumn("txn_id", F.when(F.expr("event_id % 41 = 0"), F.col("txn_id")).otherwise(C.txn_id_for(key, F.col("event_ms"))))
        .withColumn("card_hash", F.when(F.expr("event_id % 31 <> 0"), F.col("card_hash")))
        .withColumn("currency", F.expr("if(event_id % 37 = 0, 'EURO', currency)"))
        .withColumn("rrn", F.expr("if(event_id % 43 = 0, concat(rrn, '0'), rrn)"))
        .withColumn("risk_score", F.expr("cast(100 + (event_id * 37) % 950 AS int)")),
        now(),
    )
    return rows


@query(
    "v13_constraint_check",
    f"""WITH {o.TX}, k AS (SELECT *, sha256('ik-' || event_id || '|' || event_ms) AS d, (100 + (event_id * 37) % 950) AS score FROM tx),
    c AS (SELECT CASE WHEN event_id % 41 = 0 THEN txn_id ELSE
      substr(d,1,8) || '-' || substr(d,9,4) || '-4' || substr(d,14,3) || '-a' || substr(d,18,3) || '-' || substr(d,21,12) END AS txn_id,
      CASE WHEN event_id % 31 = 0 THEN 'constraint_violation: card_hash is null'
           WHEN event_id % 41 = 0 THEN 'constraint_violation: txn_id is not a uuid'
           WHEN event_id % 37 = 0 THEN 'constraint_violation: currency longer than 3'
           WHEN event_id % 43 = 0 THEN 'constraint_violation: rrn longer than 12'
           WHEN score > 1000 THEN 'constraint_violation: risk_score outside 100..1000' END AS reason FROM k)
    SELECT txn_id, reason FROM c""",
)
def v13(spark, sf):
    return validation.with_constraint_reason(spoiled_rows(spark, sf)).select("txn_id", "reason")


@query(
    "v14_rrn_format",
    f"""WITH {o.TX}, r AS (SELECT event_id, transaction_type, channel,
      CASE WHEN event_id % 43 = 0 THEN substr(rrn, 2) ELSE rrn END AS rrn FROM tx)
    SELECT event_id, concat_ws('; ',
      CASE WHEN NOT regexp_full_match(rrn, '[0-9]{{12}}') THEN 'rrn: does not match pattern ^[0-9]{{12}}$' END,
      CASE WHEN transaction_type NOT IN (1, 2, 3) THEN 'transaction_type: not allowed' END,
      CASE WHEN channel NOT IN (1, 2) THEN 'channel: not allowed' END) AS format_failures FROM r""",
)
def v14(spark, sf):
    t = sd.transactions(spark, sf).withColumn("rrn", F.expr("if(event_id % 43 = 0, substring(rrn, 2), rrn)"))
    return validation.optional_format_failures(t).select("event_id", F.concat_ws("; ", "format_failures").alias("format_failures"))


# card numbers written with separators, some too short to show any digit
_PAN_SQL = """CASE WHEN event_id % 10 = 0 THEN 'n/a ' || event_id
    ELSE substr(pan, 1, 4) || ' ' || substr(pan, 5, 4) || '-' || substr(pan, 9) END"""


def written_pans(spark, sf):
    return sd.transactions(spark, sf).withColumn(
        "written",
        F.expr(
            "if(event_id % 10 = 0, concat('n/a ', event_id), "
            "concat(substring(pan, 1, 4), ' ', substring(pan, 5, 4), '-', substring(pan, 9)))"
        ),
    )


_PANS = f"{o.TX}, pans AS (SELECT *, {_PAN_SQL} AS written, regexp_replace({_PAN_SQL}, '[^0-9]', '', 'g') AS digits FROM tx)"

query("p01_strip_non_digits", f"WITH {_PANS} SELECT event_id, digits FROM pans")(
    lambda spark, sf: written_pans(spark, sf).select("event_id", C.strip_non_digits(F.col("written")).alias("digits"))
)
query(
    "p02_mask_pan",
    f"""WITH {_PANS} SELECT event_id, CASE WHEN length(digits) <= 10 THEN repeat('X', length(digits))
    ELSE left(digits, 6) || repeat('X', length(digits) - 10) || right(digits, 4) END AS masked_pan FROM pans""",
)(lambda spark, sf: written_pans(spark, sf).select("event_id", C.mask_pan(F.col("written")).alias("masked_pan")))
query(
    "p03_mask_last4",
    f"WITH {o.REQ} SELECT event_id, 'XXXXXXXXXXXX' || right(regexp_replace(pan_last4, '[^0-9]', '', 'g'), 4) AS masked_pan FROM req",
)(lambda spark, sf: sd.requests(spark, sf).select("event_id", C.mask_last4(F.col("pan_last4")).alias("masked_pan")))
query("p04_card_hash", f"WITH {_PANS} SELECT event_id, {o.hash_sql('written')} AS card_hash FROM pans")(
    lambda spark, sf: written_pans(spark, sf).select("event_id", C.card_hash(F.col("written"), sd.SECRET).alias("card_hash"))
)
query(
    "p05_verify_hash",
    f"""WITH {_PANS}, kept AS (SELECT event_id, card_hash,
      CASE event_id % 3 WHEN 0 THEN card_hash WHEN 1 THEN upper(card_hash) ELSE reverse(card_hash) END AS stored FROM pans)
    SELECT event_id, stored <> card_hash AS tampered FROM kept WHERE lower(stored) <> card_hash""",
)(
    lambda spark, sf: sd.transactions(spark, sf)
    .withColumn(
        "stored",
        F.expr("CASE event_id % 3 WHEN 0 THEN card_hash WHEN 1 THEN upper(card_hash) ELSE reverse(card_hash) END"),
    )
    .filter(~C.hash_matches(F.col("pan"), F.col("stored"), sd.SECRET))
    .select("event_id", (F.col("stored") != F.col("card_hash")).alias("tampered"))
)


@query(
    "p06_build_event",
    f"""WITH {o.REQ} SELECT txn_id, {o.ts_text('ts')} AS txn_timestamp, {o.hash_sql('pan')} AS card_hash,
    left(pan, 6) || 'XXXXXX' || right(pan, 4) AS masked_pan, amount_minor, currency, merchant_id, terminal_id, mcc,
    transaction_type, channel, scheme, rrn FROM req""",
)
def p06(spark, sf):
    return flow.to_events(sd.requests(spark, sf), sd.SECRET)


@query(
    "p07_assign_txn_id",
    f"""WITH {o.REQ}, h AS (SELECT event_id, sha256(idempotency_key || '|' || ms) AS d FROM req)
    SELECT event_id, substr(d,1,8) || '-' || substr(d,9,4) || '-4' || substr(d,14,3) || '-a' || substr(d,18,3) || '-' || substr(d,21,12) AS txn_id FROM h""",
)
def p07(spark, sf):
    return sd.requests(spark, sf).select("event_id", C.txn_id_for(F.col("idempotency_key"), F.col("ms")).alias("txn_id"))


@query(
    "p08_enum_labels",
    f"""WITH {o.DECIDED} SELECT event_id, {o.case('transaction_type', fv.TRANSACTION_TYPES, 'unknown')} AS transaction_type,
    {o.case('channel', fv.CHANNELS, 'unknown')} AS channel, {o.case('scheme', fv.SCHEMES, 'unknown')} AS scheme,
    {o.case('event_id % 5', fv.STATUS_LABELS, 'UNKNOWN')} AS decision FROM dec""",
)
def p08(spark, sf):
    return sd.decided(spark, sf).select(
        "event_id",
        C.transaction_type_label(F.col("transaction_type")).alias("transaction_type"),
        C.channel_label(F.col("channel")).alias("channel"),
        C.scheme_label(F.col("scheme")).alias("scheme"),
        C.status_label(F.col("event_id") % 5).alias("decision"),
    )


@query(
    "p09_status_mirror",
    f"WITH {o.DECIDED} SELECT txn_id, {_STATUS} AS status, {_STATUS} AS decision FROM dec",
)
def p09(spark, sf):
    return stored_rows(spark, sf).select("txn_id", "status", "decision")


@query(
    "p10_parse_ts",
    f"""WITH {o.TX} SELECT event_id, CASE event_id % 5
      WHEN 0 THEN event_ms WHEN 1 THEN event_ms // 1000 * 1000 - 14400000 WHEN 2 THEN event_ms // 1000 * 1000
      ELSE 1709251200000 END AS parsed_ms FROM tx""",
)
def p10(spark, sf):
    written = F.expr(
        "CASE event_id % 5 WHEN 0 THEN txn_timestamp "
        "WHEN 1 THEN concat(substring(txn_timestamp, 1, 19), '+04:00') "
        "WHEN 2 THEN concat(substring(txn_timestamp, 1, 19), 'Z') "
        "WHEN 3 THEN substring(txn_timestamp, 1, 10) ELSE replace(txn_timestamp, 'T', ' ') END"
    )
    return sd.transactions(spark, sf).select("event_id", F.unix_millis(C.parse_ts(written, now())).alias("parsed_ms"))


@query(
    "p11_risk_request",
    f"""WITH {o.FEATURES} SELECT txn_id, amount_minor, txn_count_1hr, amount_sum_1hr, merchant_risk, is_night
    FROM feat WHERE event_type <> 'view'""",
)
def p11(spark, sf):
    txns = sd.transactions(spark, sf).withColumn("txn_id", F.expr("if(event_type = 'view', '', txn_id)"))
    df = flow.score_transactions(txns, sd.merchants(spark, sf), now(), clock_ms=F.col("vms"))
    return flow.risk_requests(df).select(
        "txn_id", "amount_minor", "features.txn_count_1hr", "features.amount_sum_1hr", "features.merchant_risk", "features.is_night"
    )


# --- rules -----------------------------------------------------------------------

for _i, (_rule, _sql) in enumerate(o.RULE_SQL.items(), 1):

    def _fires(spark, sf, rule=_rule):
        t = sd.transactions(spark, sf)
        return t.filter(rules.rule_columns(C.parse_ts(F.col("txn_timestamp"), now()))[rule]).select("txn_id")

    query(f"r{_i:02d}_{_rule.lower()}", f"WITH {o.TX} SELECT txn_id FROM tx WHERE {_sql}")(_fires)


@query("r09_triggered_rules", f"WITH {o.TX} SELECT txn_id, {o.TRIGGERED} AS triggered_rules FROM tx")
def r09(spark, sf):
    return rules.with_rules(sd.transactions(spark, sf), now()).select("txn_id", text("triggered_rules"))


@query(
    "r10_rule_flags",
    f"""WITH {o.TX} SELECT txn_id, CASE WHEN event_id % 8 <> 0 AND hour(ts) < 5 THEN 1 ELSE 0 END AS is_night,
    CASE WHEN {o.RULE_SQL['RISKY_MCC']} THEN 1 ELSE 0 END AS is_risky_mcc,
    CASE WHEN channel = 2 THEN 1 ELSE 0 END AS is_card_not_present FROM tx""",
)
def r10(spark, sf):
    t = sd.transactions(spark, sf).withColumn("event_ts", C.parse_ts(F.expr("if(event_id % 8 = 0, 'soon', txn_timestamp)")))
    return t.select("txn_id", *[c.alias(n) for n, c in rules.rule_flags(F.col("event_ts")).items()])


# another rule set: all seven condition types with other settings, one rule switched off
OTHER_RULES = [
    {"id": "BIG", "enabled": True, "score_contribution": 10,
     "condition": {"type": "amount_threshold", "thresholds": {"OMR": 20000, "DEFAULT": 90000}}},
    {"id": "ROUND", "enabled": True, "score_contribution": 20,
     "condition": {"type": "round_amount", "divisible_by": 1000, "min_minor": 5000}},
    {"id": "FOOD", "enabled": True, "score_contribution": 30,
     "condition": {"type": "mcc_list", "mcc_codes": ["5411", "5812"]}},
    {"id": "LATE", "enabled": True, "score_contribution": 40,
     "condition": {"type": "time_window", "start_hour_utc": 22, "end_hour_utc": 3}},
    {"id": "OFF", "enabled": False, "score_contribution": 50,
     "condition": {"type": "channel_match", "channels": ["POS"]}},
    {"id": "SHOP", "enabled": True, "score_contribution": 60,
     "condition": {"type": "channel_match", "channels": ["POS"]}},
    {"id": "MONDAY_BIG", "enabled": True, "score_contribution": 70,
     "condition": {"type": "composite", "requires_rules": ["BIG"], "day_of_week": ["MONDAY"]}},
    {"id": "NEEDS_OFF", "enabled": True, "score_contribution": 80,
     "condition": {"type": "composite", "requires_rules": ["OFF"]}},
    {"id": "NOT_GULF", "enabled": True, "score_contribution": 90,
     "condition": {"type": "currency_not_in", "domestic_currencies": ["OMR", "AED"]}},
]
# configured limits over the built-in ones: only the default and OMR change
_OTHER_LIMIT = (
    "CASE currency "
    + " ".join(f"WHEN '{c}' THEN {20000 if c == 'OMR' else v}" for c, v in fv.HIGH_AMOUNT_THRESHOLDS.items())
    + " ELSE 90000 END"
)
_OTHER = {
    "BIG": (f"amount_minor > {_OTHER_LIMIT}", 10),
    "ROUND": ("amount_minor > 5000 AND amount_minor % 1000 = 0", 20),
    "FOOD": ("mcc IN ('5411', '5812')", 30),
    "LATE": ("(hour(ts) >= 22 OR hour(ts) < 3)", 40),
    "SHOP": ("channel = 1", 60),
    "MONDAY_BIG": (f"amount_minor > {_OTHER_LIMIT} AND dayofweek(ts) = 1", 70),
    "NOT_GULF": ("currency NOT IN ('OMR', 'AED')", 90),
}


@query(
    "r11_rules_from_config",
    f"WITH {o.TX} SELECT txn_id, concat_ws(',', "
    + ", ".join(f"CASE WHEN {sql} THEN '{n}' END" for n, (sql, _) in _OTHER.items())
    + ") AS triggered_rules FROM tx",
)
def r11(spark, sf):
    return rules.with_rules(sd.transactions(spark, sf), now(), OTHER_RULES).select("txn_id", text("triggered_rules"))


@query(
    "r12_rule_toggle",
    f"WITH {o.TX} SELECT txn_id, concat_ws(',', "
    + ", ".join(
        f"CASE WHEN {sql} THEN '{n}' END" for n, sql in o.RULE_SQL.items() if n not in ("HIGH_AMOUNT", "WEEKEND_HIGH_AMOUNT")
    )
    + ") AS triggered_rules FROM tx",
)
def r12(spark, sf):
    toggled = [{**r, "enabled": r["id"] != "HIGH_AMOUNT"} for r in fv.RULES]
    return rules.with_rules(sd.transactions(spark, sf), now(), toggled).select("txn_id", text("triggered_rules"))


@query("r13_rule_points", f"WITH {o.TX} SELECT txn_id, {o.POINTS} AS points FROM tx")
def r13(spark, sf):
    t = sd.transactions(spark, sf)
    return t.select("txn_id", rules.points(C.parse_ts(F.col("txn_timestamp"), now())).alias("points"))


@query(
    "r14_velocity_triggers",
    f"WITH {o.VELOCITY} SELECT txn_id, concat_ws(',', "
    + ", ".join(f"CASE WHEN {col} >= {limit} THEN '{n}' END" for n, col, limit, _ in fv.VELOCITY_RULES)
    + ") AS velocity_rules FROM vel",
)
def r14(spark, sf):
    v = velocity.with_velocity(vms_transactions(spark, sf))
    return v.select("txn_id", F.concat_ws(",", rules.velocity_triggers()).alias("velocity_rules"))


OTHER_VELOCITY = {
    "TXN_COUNT_1MIN": {"threshold": 2},
    "TXN_COUNT_1HR": {"enabled": False},
    "AMOUNT_SUM_1HR": {"threshold": 5000000, "score_contribution": 7},
}


@query(
    "r14_velocity_settings",
    f"""WITH {o.VELOCITY} SELECT txn_id, concat_ws(',', CASE WHEN txn_count_1min >= 2 THEN 'TXN_COUNT_1MIN' END,
      CASE WHEN txn_count_5min >= 10 THEN 'TXN_COUNT_5MIN' END, CASE WHEN amount_sum_1min >= 100000 THEN 'AMOUNT_SUM_1MIN' END,
      CASE WHEN amount_sum_1hr >= 5000000 THEN 'AMOUNT_SUM_1HR' END,
      CASE WHEN unique_merchants_5min >= 3 THEN 'UNIQUE_MERCHANTS_5MIN' END,
      CASE WHEN unique_terminals_5min >= 4 THEN 'UNIQUE_TERMINALS_5MIN' END) AS velocity_rules,
    (CASE WHEN txn_count_1min >= 2 THEN 250 ELSE 0 END + CASE WHEN txn_count_5min >= 10 THEN 150 ELSE 0 END
     + CASE WHEN amount_sum_1min >= 100000 THEN 200 ELSE 0 END + CASE WHEN amount_sum_1hr >= 5000000 THEN 7 ELSE 0 END
     + CASE WHEN unique_merchants_5min >= 3 THEN 180 ELSE 0 END
     + CASE WHEN unique_terminals_5min >= 4 THEN 120 ELSE 0 END) AS velocity_points FROM vel""",
)
def r14_settings(spark, sf):
    v = velocity.with_velocity(vms_transactions(spark, sf))
    return v.select(
        "txn_id",
        F.concat_ws(",", rules.velocity_triggers(OTHER_VELOCITY)).alias("velocity_rules"),
        rules.velocity_points(OTHER_VELOCITY).alias("velocity_points"),
    )


# --- joins -----------------------------------------------------------------------


@query(
    "j01_merchant_risk",
    f"WITH {o.TX}, {o.MERCHANTS} SELECT txn_id, coalesce(risk, 0.5)::DOUBLE AS merchant_risk FROM tx LEFT JOIN mer USING (merchant_id)",
)
def j01(spark, sf):
    return joins.with_merchant_risk(sd.transactions(spark, sf), sd.merchants(spark, sf)).select("txn_id", "merchant_risk")


@query(
    "j02_merchant_override",
    f"""WITH {o.TX}, {o.MERCHANTS}, ov(merchant_id, score) AS (VALUES ('M00000000000003', 0.9), ('M00000000000119', 0.05))
    SELECT txn_id, coalesce(score, risk, 0.5)::DOUBLE AS merchant_risk
    FROM tx LEFT JOIN mer USING (merchant_id) LEFT JOIN ov USING (merchant_id)""",
)
def j02(spark, sf):
    overrides = {**fv.MERCHANT_OVERRIDES, "M00000000000003": 0.9, "M00000000000119": 0.05}
    return joins.with_merchant_risk(sd.transactions(spark, sf), sd.merchants(spark, sf), overrides).select(
        "txn_id", "merchant_risk"
    )


@query("j03_currency_threshold", f"WITH {o.TX} SELECT txn_id, ({o.THRESHOLD})::BIGINT AS threshold FROM tx")
def j03(spark, sf):
    return joins.with_threshold(sd.transactions(spark, sf), joins.threshold_table(spark)).select("txn_id", "threshold")


# calls that failed left no result; views ask for an id nobody submitted
@query(
    "j04_status_lookup",
    f"""WITH {o.DECIDED} SELECT CASE WHEN event_type = 'view' THEN 'x' || txn_id ELSE txn_id END AS txn_id,
    CASE WHEN event_type = 'view' THEN 'NOT_FOUND' WHEN event_type = 'error' THEN 'PENDING' ELSE {_STATUS} END AS status,
    CASE WHEN event_type IN ('view', 'error') THEN '' ELSE {o.case('decision', fv.DECISIONS, '')} END AS fraud_decision,
    CASE WHEN event_type IN ('view', 'error') THEN 0 ELSE risk_score END AS risk_score,
    CASE WHEN event_type = 'view' THEN '' ELSE txn_timestamp END AS submitted_at,
    CASE WHEN event_type IN ('view', 'error') THEN '' ELSE processed_at END AS decided_at FROM dec""",
)
def j04(spark, sf):
    d = sd.decided(spark, sf)
    ids = d.select(F.expr("if(event_type = 'view', concat('x', txn_id), txn_id)").alias("txn_id"))
    return joins.status_lookup(ids, d, d.filter("event_type <> 'error'"))


@query("j05_unprocessed", f"WITH {o.TX} SELECT txn_id, amount_minor FROM tx WHERE event_type = 'error'")
def j05(spark, sf):
    d = sd.decided(spark, sf)
    return joins.unprocessed(d, d.filter("event_type <> 'error'")).select("txn_id", "amount_minor")


@query(
    "j06_replay_filter",
    f"WITH {o.DECIDED} SELECT txn_id, txn_timestamp FROM dec WHERE event_type <> 'purchase'",
)
def j06(spark, sf):
    rows = stored_rows(spark, sf)
    before = storage.to_stored(sd.decided(spark, sf).filter("event_type = 'purchase'"), now())
    return joins.not_stored(rows, before).select("txn_id", C.format_ts(F.col("txn_timestamp")).alias("txn_timestamp"))


@query("j06_snapshot_filter", ORACLES["j06_replay_filter"])
def j06_snapshot(spark, sf):
    """Against the written table: a base of most purchases, an upsert of the others, keys read by month."""
    bought = storage.to_stored(sd.decided(spark, sf).filter("event_type = 'purchase'"), now())
    late = F.pmod(F.xxhash64("txn_id"), F.lit(5)) == 0
    table = new_table_path(spark, "snapshots")
    for part in (bought.filter(~late), bought.filter(late)):
        snapshots.upsert(spark, table, part, now())
    missing = snapshots.unstored(spark, table, stored_rows(spark, sf))
    return missing.select("txn_id", C.format_ts(F.col("txn_timestamp")).alias("txn_timestamp"))


# --- velocity and other windows --------------------------------------------------

for _i, _col in enumerate(o.VELOCITY_SQL, 1):

    def _velocity(spark, sf, col=_col):
        return velocity.with_velocity(vms_transactions(spark, sf)).select("txn_id", col)

    query(f"w{_i:02d}_{_col}", f"WITH {o.TX} SELECT txn_id, {o.VELOCITY_SQL[_col]} AS {_col} FROM tx")(_velocity)


@query(
    "x06_bucket_sketch",
    f"""WITH {o.TX} SELECT card_hash, vms // 300000 AS bucket, count(DISTINCT merchant_id)::INT AS unique_merchants_5min,
    count(DISTINCT terminal_id)::INT AS unique_terminals_5min FROM tx GROUP BY ALL""",
)
def x06(spark, sf):
    return velocity.bucket_distinct_approx(vms_transactions(spark, sf))


@query(
    "x06_stored_sketches",
    f"""WITH {o.TX} SELECT card_hash, vms // 3600000 AS hour, count(DISTINCT merchant_id) AS unique_merchants,
    count(DISTINCT terminal_id) AS unique_terminals FROM tx GROUP BY ALL""",
)
def x06_stored(spark, sf):
    """An hour's distinct counts from the stored states of its buckets."""
    states = stored(spark, sketches.bucket_states(vms_transactions(spark, sf)), "states")
    return sketches.united(states, F.col("card_hash"), F.expr("bucket div 12").alias("hour"))


_FEATURE_NAMES = [name for name, *_ in fv.MODEL]


@query(
    "w08_features",
    f"WITH {o.FEATURES} SELECT txn_id, {', '.join(_FEATURE_NAMES)} FROM feat",
)
def w08(spark, sf):
    return scored(spark, sf).select("txn_id", *_FEATURE_NAMES)


@query(
    "w11_idempotency",
    f"""WITH RECURSIVE {o.IDEMPOTENCY}
    SELECT r.txn_id, w.txn_id AS original_txn_id, r.txn_id <> w.txn_id AS is_duplicate
    FROM req r JOIN walk w ON r.idempotency_key = w.idempotency_key AND r.ms BETWEEN w.ms AND w.ms + 86399999""",
)
def w11(spark, sf):
    return dedup.with_original(sd.requests(spark, sf)).select("txn_id", "original_txn_id", "is_duplicate")


# --- lookups ---------------------------------------------------------------------

_CARD = "'4' || lpad('1', 15, '0')"


def one_card() -> str:
    inner = hashlib.sha256(b"4" + b"1".rjust(15, b"0")).digest()
    return hmac.new(sd.SECRET.encode(), inner, hashlib.sha256).hexdigest()


@query(
    "t02_card_history",
    f"""WITH {o.DECIDED} SELECT txn_id, txn_timestamp, risk_score FROM dec
    WHERE card_hash = {o.hash_sql(_CARD)} ORDER BY txn_timestamp DESC, txn_id DESC LIMIT 20""",
)
def t02(spark, sf):
    return lookups.card_history(stored_rows(spark, sf), one_card(), 20).select(
        "txn_id", C.format_ts(F.col("txn_timestamp")).alias("txn_timestamp"), "risk_score"
    )


@query(
    "t03_latest_per_card",
    f"""WITH {o.DECIDED}, n AS (SELECT card_hash, txn_id,
      row_number() OVER (PARTITION BY card_hash ORDER BY txn_timestamp DESC, txn_id DESC)::INT AS recency FROM dec)
    SELECT card_hash, txn_id, recency FROM n WHERE recency <= 3""",
)
def t03(spark, sf):
    return lookups.latest_per_card(stored_rows(spark, sf), 3).select("card_hash", "txn_id", "recency")


@query("t04_by_rrn", f"WITH {o.DECIDED} SELECT txn_id, rrn, risk_score FROM dec WHERE rrn = '000000000042'")
def t04(spark, sf):
    return lookups.by_rrn(stored_rows(spark, sf), "000000000042").select("txn_id", "rrn", "risk_score")


@query("t05_by_status", f"WITH {o.DECIDED} SELECT txn_id, risk_score FROM dec WHERE decision = 2")
def t05(spark, sf):
    return lookups.by_status(stored_rows(spark, sf), "DECLINED").select("txn_id", "risk_score")


@query(
    "t06_date_range",
    f"""WITH {_MONTHS} SELECT txn_id, txn_month FROM st
    WHERE mts >= TIMESTAMP '2024-12-15 00:00:00' AND mts < TIMESTAMP '2025-05-20 00:00:00'""",
)
def t06(spark, sf):
    rows = month_rows(spark, sf)
    return lookups.date_range(rows, "2024-12-15 00:00:00", "2025-05-20 00:00:00").select("txn_id", "txn_month")


# --- scoring ---------------------------------------------------------------------

_NORMS = {
    "c01_norm_log10": ("amount_minor", "log10", 999999999999.0),
    "c02_norm_linear_cap": ("txn_count_1hr", "linear_cap", 50.0),
    "c03_norm_binary": ("txn_count_1min - 1", "binary", None),
    "c04_norm_passthrough": ("merchant_risk * 3 - 1", "passthrough", None),
}
for _name, (_expr, _method, _cap) in _NORMS.items():

    def _norm(spark, sf, expr=_expr, method=_method, cap=_cap):
        return scored(spark, sf).select("txn_id", F.round(C.normalise(F.expr(expr), method, cap), 9).alias("norm"))

    query(_name, f"WITH {o.FEATURES} SELECT txn_id, round({o.norm_sql(f'({_expr})', _method, _cap)}, 9) AS norm FROM feat")(_norm)


@query("c05_risk_score", f"WITH {o.SCORED} SELECT txn_id, risk_score FROM scored")
def c05(spark, sf):
    return scored(spark, sf).select("txn_id", "risk_score")


@query(
    "c06_decide",
    f"WITH {o.SCORED} SELECT txn_id, {o.case('decision', fv.DECISIONS, 'DECISION_UNSPECIFIED')} AS decision FROM scored",
)
def c06(spark, sf):
    return scored(spark, sf).select("txn_id", scoring.decision_name(F.col("decision")).alias("decision"))


def with_failed_calls(spark, sf):
    return scored(spark, sf, answered=F.col("event_type") != "error")


@query("c07_fallback", f"WITH {o.FALLBACK} SELECT txn_id, risk_score, decision, score_source FROM fb")
def c07(spark, sf):
    return with_failed_calls(spark, sf).select("txn_id", "risk_score", "decision", "score_source")


@query("c08_contributing_factors", f"WITH {o.SCORED} SELECT txn_id, contributing_factors FROM scored")
def c08(spark, sf):
    return scored(spark, sf).select("txn_id", text("contributing_factors"))


_RESULT_COLUMNS = [*[f.name for f in TRANSACTIONS.fields], "processed_at", "decision", "risk_score", "triggered_rules", "contributing_factors"]


# nations as models, their suppliers as features
@query(
    "c09_model_check",
    """WITH f AS (SELECT s_nationkey AS model_id, s_suppkey % 6 AS feature, s_suppkey * 37 % 101 AS hundredths FROM supplier),
    l AS (SELECT model_id, feature, sum(hundredths) AS s, count(*) AS times FROM f GROUP BY ALL),
    m AS (SELECT n_nationkey AS model_id, sum(s) AS total, max(times) AS times FROM nation LEFT JOIN l ON model_id = n_nationkey GROUP BY 1)
    SELECT model_id, 'no feature' AS fault FROM m WHERE total IS NULL
    UNION ALL SELECT model_id, 'weights add up to more than 1' FROM m WHERE total > 400
    UNION ALL SELECT model_id, 'a feature is listed twice' FROM m WHERE times > 1""",
)
def c09(spark, sf):
    models = sd.table(spark, sf, "nation").select(F.col("n_nationkey").alias("model_id"))
    weight = F.expr("(s_suppkey * 37 % 101) / 400")
    features = sd.table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("model_id"), F.expr("s_suppkey % 6").alias("feature"), weight.alias("weight")
    )
    return scoring.model_faults(models, features)


@query(
    "c10_score_transactions",
    f"""WITH {o.SCORED} SELECT * FROM (SELECT {', '.join(c for c in _RESULT_COLUMNS if c != 'processed_at')},
    {o.ts_text('make_timestamp(processed_ms * 1000)')} AS processed_at FROM scored)""",
)
def c10(spark, sf):
    out = flow.results(scored(spark, sf), C.format_ts(F.timestamp_millis("processed_ms")))
    return out.select(*[text(c) if c in ("triggered_rules", "contributing_factors") else F.col(c) for c in _RESULT_COLUMNS])


# --- reports ---------------------------------------------------------------------

_BY_NAME = f"{o.SCORED}, named AS (SELECT * REPLACE ({o.case('decision', fv.DECISIONS, '')} AS decision) FROM scored)"

query("a01_decision_counts", f"WITH {_BY_NAME} SELECT decision, count(*) AS transactions FROM named GROUP BY ALL")(
    lambda spark, sf: reports.decision_counts(scored(spark, sf))
)
query("a02_score_histogram", f"WITH {o.SCORED} {o.histogram('scored', 'risk_score', fv.SCORE_BUCKETS)}")(
    lambda spark, sf: reports.score_histogram(scored(spark, sf))
)
query(
    "a03_score_histogram_by_decision",
    f"WITH {_BY_NAME} {o.histogram('named', 'risk_score', fv.SCORE_BUCKETS, ['decision'])}",
)(lambda spark, sf: reports.score_histogram_by_decision(scored(spark, sf)))
query(
    "a04_rule_trigger_rates",
    f"WITH {o.TX} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS rule_id, count(CASE WHEN {sql} THEN 1 END) AS triggered, count(*) AS total, "
        f"count(CASE WHEN {sql} THEN 1 END) / count(*) AS rate FROM tx"
        for n, sql in o.RULE_SQL.items()
    ),
)(lambda spark, sf: reports.rule_trigger_rates(rules.with_rules(sd.transactions(spark, sf), now())))
query(
    "a05_factor_counts",
    f"WITH {o.SCORED} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS factor, count(CASE WHEN list_contains(string_split(contributing_factors, ','), '{n}') THEN 1 END) AS transactions FROM scored"
        for n in _FEATURE_NAMES
    ),
)(lambda spark, sf: reports.factor_counts(scored(spark, sf)))
query(
    "a06_fraud_ratio",
    f"""WITH {o.SCORED} SELECT count(CASE WHEN decision = 2 THEN 1 END) AS declined, count(*) AS transactions,
    count(CASE WHEN decision = 2 THEN 1 END) / count(*) AS fraud_ratio FROM scored""",
)(lambda spark, sf: reports.fraud_ratio(scored(spark, sf)))


def window_sql(src: str, ms: str, seconds: int) -> str:
    return (
        f"SELECT {ms} // {seconds * 1000} * {seconds * 1000} AS window_start_ms, count(*) AS n_rows, "
        f"count(*) / {seconds} AS rows_per_second FROM {src} GROUP BY 1"
    )


query("a07_throughput", f"WITH {o.TX} {window_sql('tx', 'vms', 60)}")(
    lambda spark, sf: reports.throughput(sd.transactions(spark, sf), F.timestamp_millis("vms"))
)


@query(
    "a09_batch_size_histogram",
    f"""WITH {o.FRAMES}, b AS (SELECT event_id // 500 AS batch_id, count(*) AS n FROM decoded WHERE reason IS NULL GROUP BY ALL)
    {o.histogram('b', 'n', fv.BATCH_BUCKETS)}""",
)
def a09(spark, sf):
    df = frames.decode(frames.triage(sd.raw_frames(spark, sf)), FRAUD_RESULTS).filter("reason IS NULL")
    return reports.batch_size_histogram(df.withColumn("batch_id", F.expr("offset div 500")))


query(
    "a10_latency_histogram",
    f"WITH {o.TX} {o.histogram('tx', '(processed_ms - vms)', fv.LATENCY_BUCKETS, scale=1000)}",
)(lambda spark, sf: reports.latency_histogram(sd.transactions(spark, sf), F.col("vms"), F.col("processed_ms")))


def stored(spark, rows, name):
    """``rows`` written and read back."""
    path = new_table_path(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _quantiles_sql(value: str, by: str) -> str:
    at = [f"max(CASE WHEN r = ({p} * n + 99) // 100 THEN v END) AS p{p}" for p in (50, 95, 99)]
    return f"""WITH {o.TX if 'score' not in value else o.DECIDED}, vals AS (SELECT {by}, vms // 3600000 * 3600000 AS start_ms, {value} AS v
      FROM {'dec' if 'score' in value else 'tx'}),
    placed AS (SELECT *, row_number() OVER (PARTITION BY {by}, start_ms ORDER BY v) AS r,
      count(*) OVER (PARTITION BY {by}, start_ms) AS n FROM vals)
    SELECT {by}, start_ms, max(n) AS n_rows, {', '.join(at)} FROM placed GROUP BY {by}, start_ms"""


@query("a10_latency_quantiles", _quantiles_sql("processed_ms - vms", "terminal_id"))
def a10_quantiles(spark, sf):
    """Counts per minute and value are stored; hours come from them."""
    rows = sd.transactions(spark, sf)
    minutes = sketches.value_counts(rows, F.col("processed_ms") - F.col("vms"), F.col("vms"), "terminal_id")
    return sketches.counted_quantiles(stored(spark, minutes, "minutes"), 50, 95, 99, by=("terminal_id",))


@query("a02_score_quantiles", _quantiles_sql("risk_score", "currency"))
def a02_quantiles(spark, sf):
    minutes = sketches.value_counts(sd.decided(spark, sf), F.col("risk_score"), F.col("vms"), "currency")
    return sketches.counted_quantiles(stored(spark, minutes, "minutes"), 50, 95, 99, by=("currency",))


query(
    "a11_fallback_count",
    f"WITH {o.FALLBACK} SELECT count(CASE WHEN score_source = 'fallback' THEN 1 END) AS fallbacks, count(*) AS decisions FROM fb",
)(lambda spark, sf: reports.fallback_count(with_failed_calls(spark, sf)))
query("a12_dlq_rate", f"WITH {_QUARANTINE} {window_sql('quar', 'event_ms', 300)}")(
    lambda spark, sf: reports.quarantine_rate(quarantined(spark, sf))
)
query(
    "a12_dlq_alerts",
    f"""WITH {_QUARANTINE}, w AS ({window_sql('quar', 'event_ms', 120)}),
    grid AS (SELECT unnest(range(min(window_start_ms), max(window_start_ms) + 1, 120000)) AS window_start_ms FROM w)
    SELECT window_start_ms, coalesce(n_rows, 0) AS n_rows, coalesce(rows_per_second, 0) AS rows_per_second,
      coalesce(n_rows, 0) > 0 AS alert FROM grid LEFT JOIN w USING (window_start_ms)""",
)(lambda spark, sf: reports.quarantine_alerts(quarantined(spark, sf)))
query(
    "a13_request_rate_audit",
    f"""WITH {o.REQ} SELECT client_id, vms // 1000 AS second, count(*) AS requests, count(*) > 1 AS over_rate,
    count(*) > 2 AS over_burst FROM req GROUP BY client_id, second""",
)(lambda spark, sf: reports.request_rate(sd.requests(spark, sf), F.timestamp_millis("vms"), 1, 2))
# 30 days in some five seconds, so that clients reach the limits of 100 requests a second and bursts of 200
_FAST = "(vms - 1704067200000) // 400"
_ROOM = "least(least(2000, w.state + p.ms - w.ms) // 10, p.n)"
query(
    "a13_admission",
    f"""WITH RECURSIVE {o.REQ}, fast AS (SELECT client_id, txn_id, {_FAST} AS ms FROM req),
    per AS (SELECT client_id, ms, count(*) AS n, row_number() OVER (PARTITION BY client_id ORDER BY ms) AS i FROM fast GROUP BY client_id, ms),
    walk AS (
      SELECT client_id, i, ms, least(200, n) AS room, 2000 - 10 * least(200, n) AS state FROM per WHERE i = 1
      UNION ALL
      SELECT p.client_id, p.i, p.ms, {_ROOM}, least(2000, w.state + p.ms - w.ms) - 10 * {_ROOM}
      FROM walk w JOIN per p ON p.client_id = w.client_id AND p.i = w.i + 1),
    placed AS (SELECT *, row_number() OVER (PARTITION BY client_id, ms ORDER BY txn_id) AS place FROM fast)
    SELECT client_id, txn_id, place <= room AS admitted FROM placed JOIN walk USING (client_id, ms)""",
)(
    lambda spark, sf: admission.per_request(
        sd.requests(spark, sf).select(
            "client_id", F.expr("(vms - 1704067200000) div 400").alias("ms"), F.col("txn_id").alias("request_id")
        ),
        fv.REQUESTS_PER_SECOND, fv.REQUEST_BURST, block_ms=500, chunk=4,
    ).select("client_id", F.col("request_id").alias("txn_id"), "admitted")
)
query(
    "a14_table_profile",
    f"WITH {_MONTHS} SELECT txn_month, status, count(*) AS n_rows, sum(amount_minor)::BIGINT AS amount_minor FROM st GROUP BY ALL",
)(lambda spark, sf: reports.table_profile(month_rows(spark, sf)))
query(
    "a15_failure_sessions",
    f"""WITH {o.TX}, f AS (SELECT user_id // 3 AS dependency, vms AS ms FROM tx WHERE event_type = 'error'),
    g AS (SELECT *, ms - lag(ms) OVER (PARTITION BY dependency ORDER BY ms) AS gap FROM f),
    s AS (SELECT *, sum(CASE WHEN gap < 30000 THEN 0 ELSE 1 END) OVER (PARTITION BY dependency ORDER BY ms
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g),
    n AS (SELECT *, row_number() OVER (PARTITION BY dependency, sid ORDER BY ms) AS rn FROM s)
    SELECT dependency, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS failures,
      min(CASE WHEN rn = 5 THEN ms END) AS opened_ms, count(*) >= 5 AS is_episode FROM n GROUP BY dependency, sid""",
)(lambda spark, sf: sessions.failure_sessions(sd.failures(spark, sf)))
