"""The same derivations and operators in plain SQL, for checking."""

from __future__ import annotations

from ..functions import fixed_values as fv
from ..sources.sample_data import EPOCH_MS, SECRET


def _pad(byte: int) -> str:
    return bytes(b ^ byte for b in SECRET.encode().ljust(64, b"\0")).hex()


def hash_sql(pan: str) -> str:
    return (
        f"sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || "
        f"unhex(sha256(regexp_replace({pan}, '[^0-9]', '', 'g'))))))"
    )


def case(expr: str, labels: dict, default: str) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in labels.items()) + f" ELSE '{default}' END"


def ts_text(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def values(items: list) -> str:
    return "(" + ", ".join(f"'{i}'" for i in items) + ")"


def decide(score: str) -> str:
    return f"CASE WHEN {score} < {fv.APPROVE_BELOW} THEN 1 WHEN {score} > {fv.DECLINE_ABOVE} THEN 2 ELSE 3 END"


TX0 = f"""tx0 AS (
  SELECT event_id, user_id, event_type, ts, epoch_us(ts) // 1000 AS event_ms,
    {EPOCH_MS} + (epoch_us(ts) // 1000 - {EPOCH_MS}) // 1200 AS vms,
    round(value * 100)::BIGINT * pow(10, event_id % 5)::BIGINT AS scaled,
    json_extract_string(props, '$.k')::INT AS k,
    '4' || lpad(user_id::VARCHAR, 15, '0') AS pan
  FROM events)"""

TX = f"""{TX0},
tx AS MATERIALIZED (
  SELECT event_id, user_id, event_type, ts, event_ms, vms, pan,
    't' || lpad(event_id::VARCHAR, 12, '0') AS txn_id,
    {ts_text('ts')} AS txn_timestamp,
    {hash_sql('pan')} AS card_hash,
    substr(pan, 1, 6) || 'XXXXXX' || right(pan, 4) AS masked_pan,
    CASE WHEN event_id % 7 = 0 THEN (scaled // 100000 + 1) * 100000 ELSE scaled END AS amount_minor,
    ['OMR','INR','USD','AED','SAR','BHD','KWD','QAR','EUR'][(event_id % 9 + 1)::INT] AS currency,
    'M' || lpad((event_id % 120)::VARCHAR, 14, '0') AS merchant_id,
    'T' || lpad((event_id % 60)::VARCHAR, 7, '0') AS terminal_id,
    ['5411','7995','6051','6099','4829','5912','5812','6011',''][k % 9 + 1] AS mcc,
    (event_id % 5)::INT AS transaction_type,
    CASE WHEN event_type IN ('click','view') THEN 2 WHEN event_type = 'error' THEN 0 ELSE 1 END AS channel,
    (user_id % 5)::INT AS scheme,
    lpad(event_id::VARCHAR, 12, '0') AS rrn,
    vms + (event_id * 37) % 3000 AS processed_ms
  FROM tx0)"""

REQ = f"""{TX},
req AS MATERIALIZED (
  SELECT event_id, user_id, event_type, ts, event_ms AS ms, vms, txn_id, pan, transaction_type, channel, scheme, rrn,
    CASE WHEN event_id % 47 = 0 THEN 0 WHEN event_id % 53 = 0 THEN 1000000000000 ELSE amount_minor END AS amount_minor,
    CASE WHEN event_id % 13 = 0 THEN ['12a4','123','1234' || chr(10),'12345'][(event_id % 4 + 1)::INT]
         ELSE right(pan, 4) END AS pan_last4,
    CASE WHEN event_id % 29 = 0 THEN chr(9) ELSE card_hash END AS card_hash,
    CASE WHEN event_id % 31 = 0 THEN lower(currency) ELSE currency END AS currency,
    CASE WHEN event_id % 19 = 0 THEN merchant_id || 'é345é8' ELSE merchant_id END AS merchant_id,
    CASE WHEN event_id % 23 = 0 THEN '54A1' ELSE mcc END AS mcc,
    CASE WHEN event_id % 17 = 0 THEN terminal_id || 'éééééé' ELSE terminal_id END AS terminal_id,
    CASE WHEN event_id % 11 = 0 THEN ' ' || chr(9) ELSE 'ik-' || user_id || '-' || event_type END AS idempotency_key,
    'c' || (user_id % 10) AS client_id
  FROM tx)"""

MERCHANTS = """mer AS (
  SELECT 'M' || lpad(s_suppkey::VARCHAR, 14, '0') AS merchant_id, ((s_suppkey * 37) % 101) / 100.0 AS risk,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(s_suppkey) AS updated_at
  FROM supplier)"""

DECIDED = f"""{TX},
dec0 AS (SELECT *, (100 + (event_id * 37) % 901)::INT AS risk_score,
    {ts_text('make_timestamp(processed_ms * 1000)')} AS processed_at FROM tx),
dec AS MATERIALIZED (SELECT *, {decide('risk_score')} AS decision,
    concat_ws(',', CASE WHEN channel = 2 THEN 'CARD_NOT_PRESENT' END,
                   CASE WHEN currency = 'USD' THEN 'FOREIGN_CURRENCY' END) AS triggered_rules FROM dec0)"""

FRAMES = f"""{DECIDED},
fr AS MATERIALIZED (
  SELECT *, (user_id % 12)::INT AS part,
    '{{"txn_id":"' || txn_id || '","txn_timestamp":"' || txn_timestamp || '","card_hash":"' || card_hash ||
    '","amount_minor":' || amount_minor || ',"currency":"' || currency || '","decision":' || decision ||
    ',"risk_score":' || risk_score || ',"triggered_rules":["' || event_type || '"]' ||
    CASE WHEN event_id % 50 = 2 THEN '' ELSE '}}' END AS payload
  FROM dec),
frames AS MATERIALIZED (
  SELECT *, CASE event_id % 50
      WHEN 0 THEN unhex('000102')
      WHEN 1 THEN unhex('010000000007') || encode(payload)
      ELSE unhex('0000000007') || encode(payload) END AS value
  FROM fr),
tri AS MATERIALIZED (
  SELECT *, CASE WHEN octet_length(value) < 5 THEN 'message too short (' || octet_length(value) || ' bytes)'
      WHEN substr(hex(value), 1, 2) <> '00' THEN 'invalid Confluent magic byte: 0x' || lower(substr(hex(value), 1, 2))
      END AS frame_reason
  FROM frames),
decoded AS MATERIALIZED (
  SELECT *, CASE WHEN frame_reason IS NOT NULL THEN frame_reason
      WHEN NOT json_valid(payload) THEN 'payload cannot be decoded' END AS reason
  FROM tri)"""

THRESHOLD = (
    "CASE currency "
    + " ".join(f"WHEN '{c}' THEN {v}" for c, v in fv.HIGH_AMOUNT_THRESHOLDS.items())
    + f" ELSE {fv.HIGH_AMOUNT_DEFAULT} END"
)

RULE_SQL = {
    "HIGH_AMOUNT": f"amount_minor > ({THRESHOLD})",
    "ROUND_AMOUNT": "amount_minor > 100000 AND amount_minor % 100000 = 0",
    "RISKY_MCC": f"mcc IN {values(fv.RISKY_MCCS)}",
    "CRYPTO_EXCHANGE_MCC": f"mcc IN {values(fv.CRYPTO_MCCS)}",
    "NIGHT_TRANSACTION": "hour(ts) < 5",
    "WEEKEND_HIGH_AMOUNT": f"amount_minor > ({THRESHOLD}) AND dayofweek(ts) IN (0, 6)",
    "CARD_NOT_PRESENT": "channel = 2",
    "FOREIGN_CURRENCY": f"currency NOT IN {values(fv.DOMESTIC_CURRENCIES)}",
}
TRIGGERED = "concat_ws(',', " + ", ".join(f"CASE WHEN {sql} THEN '{name}' END" for name, sql in RULE_SQL.items()) + ")"
POINTS = " + ".join(
    f"CASE WHEN {RULE_SQL[r['id']]} THEN {r['score_contribution']} ELSE 0 END" for r in fv.RULES
)


def frame_sql(ms: int) -> str:
    return f"OVER (PARTITION BY card_hash ORDER BY vms RANGE BETWEEN {ms - 1} PRECEDING AND CURRENT ROW)"


_BUCKET = "OVER (PARTITION BY card_hash, vms // 300000 ORDER BY vms RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
VELOCITY_SQL = {
    "txn_count_1min": f"(count(*) {frame_sql(60000)})::INT",
    "txn_count_5min": f"(count(*) {frame_sql(300000)})::INT",
    "txn_count_1hr": f"(count(*) {frame_sql(3600000)})::INT",
    "amount_sum_1min": f"(sum(amount_minor) {frame_sql(60000)})::BIGINT",
    "amount_sum_1hr": f"(sum(amount_minor) {frame_sql(3600000)})::BIGINT",
    "unique_merchants_5min": f"(count(DISTINCT merchant_id) {_BUCKET})::INT",
    "unique_terminals_5min": f"(count(DISTINCT terminal_id) {_BUCKET})::INT",
}

VELOCITY = f"""{TX},
vel AS MATERIALIZED (
  SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in VELOCITY_SQL.items())} FROM tx)"""


def norm_sql(name: str, method: str, cap: float | None) -> str:
    if method == "log10":
        return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, log10(greatest({name}::DOUBLE, 1.0::DOUBLE)) / log10({cap:.0f}::DOUBLE)))"
    if method == "linear_cap":
        return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, least({name}::DOUBLE, {cap}::DOUBLE) / {cap}::DOUBLE))"
    if method == "binary":
        return f"CASE WHEN {name} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {name}::DOUBLE))"


_PARTS = {name: f"(({norm_sql(name, method, cap)}) * {weight}::DOUBLE)" for name, weight, method, cap in fv.MODEL}
SCORE = (
    "least(1000, greatest(100, floor(100.0::DOUBLE + (0.0::DOUBLE + "
    + " + ".join(_PARTS.values())
    + ") * 900.0::DOUBLE + 0.5::DOUBLE)::INT))"
)
FACTORS = (
    "concat_ws(',', "
    + ", ".join(
        f"CASE WHEN {_PARTS[name]} > {fv.FACTOR_SHARE * weight!r}::DOUBLE THEN '{name}' END" for name, weight, _, _ in fv.MODEL
    )
    + ")"
)

FEATURES = f"""{VELOCITY}, {MERCHANTS},
feat AS MATERIALIZED (
  SELECT vel.*, coalesce(mer.risk, 0.5)::DOUBLE AS merchant_risk,
    CASE WHEN hour(ts) < 5 THEN 1 ELSE 0 END AS is_night,
    CASE WHEN {RULE_SQL['RISKY_MCC']} THEN 1 ELSE 0 END AS is_risky_mcc,
    CASE WHEN channel = 2 THEN 1 ELSE 0 END AS is_card_not_present
  FROM vel LEFT JOIN mer USING (merchant_id))"""

SCORED = f"""{FEATURES},
sc0 AS (SELECT *, {SCORE} AS risk_score, {FACTORS} AS contributing_factors, {TRIGGERED} AS triggered_rules FROM feat),
scored AS MATERIALIZED (SELECT *, {decide('risk_score')} AS decision FROM sc0)"""

# rows whose scoring call failed take the fallback score
FALLBACK = f"""{SCORED},
fb0 AS (SELECT * REPLACE (CASE WHEN event_type = 'error' THEN {fv.FALLBACK_SCORE} ELSE risk_score END AS risk_score),
  CASE WHEN event_type = 'error' THEN 'fallback' ELSE 'model' END AS score_source FROM sc0),
fb AS (SELECT *, {decide('risk_score')} AS decision FROM fb0)"""

CHECK_SQL = {
    "idempotency_key": (r"regexp_matches(idempotency_key, '^\s*$')", "'idempotency_key: required'"),
    "card_hash": (r"regexp_matches(card_hash, '^\s*$')", "'card_hash: required'"),
    "pan_last4": ("NOT regexp_full_match(pan_last4, '[0-9]{4}')", "'pan_last4: must be exactly 4 digits'"),
    "amount": ("amount_minor < 1 OR amount_minor > 999999999999", "'amount_minor: must be 1–999999999999'"),
    "currency": (
        f"upper(currency) NOT IN {values(fv.SUPPORTED_CURRENCIES)}",
        "'currency: unsupported value \"' || currency || '\"'",
    ),
    "transaction_type": ("transaction_type = 0", "'transaction_type: required'"),
    "channel": ("channel = 0", "'channel: required'"),
    "mcc": ("mcc <> '' AND NOT regexp_full_match(mcc, '[0-9]{4}')", "'mcc: does not match pattern ^[0-9]{4}$'"),
    "terminal_id": ("octet_length(encode(terminal_id)) > 16", "'terminal_id: exceeds max length 16'"),
    "merchant_id": ("octet_length(encode(merchant_id)) > 20", "'merchant_id: exceeds max length 20'"),
}
ERRORS = "concat_ws('; ', " + ", ".join(f"CASE WHEN {bad} THEN {msg} END" for bad, msg in CHECK_SQL.values()) + ")"

# first request per key wins for 24 h; walk from each original to the next
IDEMPOTENCY = f"""{REQ},
firsts AS (SELECT idempotency_key, ms, min(txn_id) AS txn_id FROM req GROUP BY ALL),
nexts AS (
  SELECT a.idempotency_key, a.ms, a.txn_id, min(b.ms) AS next_ms
  FROM firsts a LEFT JOIN firsts b ON a.idempotency_key = b.idempotency_key AND b.ms >= a.ms + 86400000
  GROUP BY ALL),
walk AS (
  SELECT n.* FROM nexts n
    JOIN (SELECT idempotency_key, min(ms) AS ms FROM firsts GROUP BY ALL) USING (idempotency_key, ms)
  UNION ALL
  SELECT n.* FROM walk w JOIN nexts n ON n.idempotency_key = w.idempotency_key AND n.ms = w.next_ms)"""


def histogram(src: str, value: str, buckets: list, by: list[str] = (), scale: int = 1) -> str:
    group = ", ".join(by)
    keys = f"{group}, " if by else ""
    counts = "\nUNION ALL ".join(
        f"SELECT {keys}'{b:g}' AS le, count(CASE WHEN {value} <= {b * scale:g} THEN 1 END) AS bucket_count, "
        f"sum({value})::BIGINT AS value_sum, count({value}) AS value_count FROM {src}"
        + (f" GROUP BY {group}" if by else "")
        for b in buckets
    )
    last = (
        f"SELECT {keys}'+Inf' AS le, count({value}) AS bucket_count, sum({value})::BIGINT AS value_sum, "
        f"count({value}) AS value_count FROM {src}" + (f" GROUP BY {group}" if by else "")
    )
    return f"{counts}\nUNION ALL {last}"
