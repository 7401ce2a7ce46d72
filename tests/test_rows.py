"""Validation, rules, scoring and lookups at their boundaries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillwatch.functions import columns as C
from tillwatch.functions import fixed_values as fv
from tillwatch.operators import joins, rules, scoring, validation
from tillwatch.plans import scoring_flow as flow
from tillwatch.schemas import MERCHANTS, REQUESTS, TRANSACTIONS, fill_absent
from tillwatch.sources import frames

GOOD = dict(
    pan="4111111111111111", pan_last4="1111", card_hash="ab", amount_minor=50000, currency="OMR",
    merchant_id="M00000000000123", mcc="5411", transaction_type=1, channel=1, terminal_id="T0000456",
    idempotency_key="k", client_id="c", ts=dt.datetime(2025, 6, 15, 14, 30),
)


def now():
    return F.lit("2025-06-15 03:00:00").cast("timestamp")


def failures(spark, **changes):
    row = {**GOOD, **changes}
    df = spark.createDataFrame([tuple(row.get(f.name) for f in REQUESTS.fields)], REQUESTS)
    return validation.with_failures(fill_absent(df, REQUESTS)).first()


def test_good_request(spark):
    assert failures(spark)["error"] is None
    assert failures(spark, currency="omr", mcc="")["error"] is None


@pytest.mark.parametrize(
    "changes,message",
    [
        ({"idempotency_key": "  "}, "idempotency_key: required"),
        ({"card_hash": None}, "card_hash: required"),
        ({"pan_last4": "1234\n"}, "pan_last4: must be exactly 4 digits"),
        ({"pan_last4": "١٢٣٤"}, "pan_last4: must be exactly 4 digits"),
        ({"amount_minor": 0}, "amount_minor: must be 1–999999999999"),
        ({"amount_minor": 10**12}, "amount_minor: must be 1–999999999999"),
        ({"currency": 'E"R\n'}, 'currency: unsupported value "E\\"R\\n"'),
        ({"transaction_type": 0}, "transaction_type: required"),
        ({"channel": None}, "channel: required"),
        ({"mcc": "123"}, "mcc: does not match pattern ^[0-9]{4}$"),
        ({"terminal_id": "é" * 9}, "terminal_id: exceeds max length 16"),
        ({"merchant_id": "m" * 21}, "merchant_id: exceeds max length 20"),
    ],
)
def test_one_failure(spark, changes, message):
    assert failures(spark, **changes)["error"] == f"validation failed: {message}"


def test_all_failures_in_order(spark):
    row = failures(spark, **{k: None for k in GOOD if k != "ts"})
    assert [m.split(":")[0] for m in row["failures"]] == [
        "idempotency_key", "card_hash", "pan_last4", "amount_minor", "currency", "transaction_type", "channel",
    ]


def txn(spark, **changes):
    base = dict(
        txn_id="t1", txn_timestamp="2025-06-16T14:30:00Z", card_hash="c", masked_pan="", amount_minor=1, currency="OMR",
        merchant_id="m", terminal_id="t", mcc="5411", transaction_type=1, channel=1, scheme=2, rrn="",
    )
    base.update(changes)
    return fill_absent(spark.createDataFrame([tuple(base[f.name] for f in TRANSACTIONS.fields)], TRANSACTIONS), TRANSACTIONS)


@pytest.mark.parametrize(
    "changes,fired",
    [
        ({"amount_minor": 500000}, ["ROUND_AMOUNT"]),
        ({"amount_minor": 500001}, ["HIGH_AMOUNT"]),
        ({"amount_minor": 100000}, []),
        ({"amount_minor": 200000}, ["ROUND_AMOUNT"]),
        ({"amount_minor": 153001, "currency": "KWD"}, ["HIGH_AMOUNT"]),
        ({"amount_minor": 500001, "currency": "QAR"}, ["HIGH_AMOUNT"]),
        ({"currency": None}, ["FOREIGN_CURRENCY"]),
        ({"currency": "omr"}, ["FOREIGN_CURRENCY"]),
        ({"mcc": "6051"}, ["RISKY_MCC", "CRYPTO_EXCHANGE_MCC"]),
        ({"channel": 2}, ["CARD_NOT_PRESENT"]),
        ({"txn_timestamp": "2025-06-16T04:59:59.999Z"}, ["NIGHT_TRANSACTION"]),
        ({"txn_timestamp": "2025-06-16T05:00:00Z"}, []),
        ({"txn_timestamp": "unreadable"}, ["NIGHT_TRANSACTION"]),
        # Saturday in local time, still Friday in UTC, and the other way round
        ({"amount_minor": 500001, "txn_timestamp": "2025-06-14T03:59:59+04:00"}, ["HIGH_AMOUNT"]),
        ({"amount_minor": 500001, "txn_timestamp": "2025-06-16T03:59:59+04:00"}, ["HIGH_AMOUNT", "WEEKEND_HIGH_AMOUNT"]),
    ],
)
def test_rules(spark, changes, fired):
    assert rules.with_rules(txn(spark, **changes), now()).first()["triggered_rules"] == fired


def test_unreadable_time_is_not_night(spark):
    df = rules.with_rules(txn(spark, txn_timestamp="?"), now())
    assert df.select(rules.rule_flags(F.col("event_ts"))["is_night"]).first()[0] == 0


def test_disabled_rule_switches_off_composites(spark):
    off = [{**r, "enabled": r["id"] != "HIGH_AMOUNT"} for r in fv.RULES]
    df = rules.with_rules(txn(spark, amount_minor=500001, txn_timestamp="2025-06-15T14:30:00Z"), now(), off)
    assert df.first()["triggered_rules"] == []


def test_unknown_condition_type(spark):
    with pytest.raises(ValueError):
        rules.rule_columns(now(), [{"id": "X", "condition": {"type": "magic"}}])


@pytest.mark.parametrize("score,name", [(100, "APPROVE"), (399, "APPROVE"), (400, "REVIEW"), (700, "REVIEW"), (701, "DECLINE")])
def test_decision_bands(spark, score, name):
    df = spark.range(1).select(scoring.decision_name(scoring.decide(F.lit(score))).alias("d"))
    assert df.first()["d"] == name


def test_model_check():
    with pytest.raises(ValueError, match="at least one"):
        scoring.check_model([])
    with pytest.raises(ValueError, match="more than 1"):
        scoring.check_model(fv.MODEL + [("extra", 0.01, "binary", None)])
    assert scoring.check_model(fv.MODEL)


def merchants(spark, *rows):
    from decimal import Decimal

    return spark.createDataFrame(
        [(m, Decimal(str(r)), dt.datetime(2025, 1, 1)) for m, r in rows] or [("none", Decimal("0.1"), dt.datetime(2025, 1, 1))],
        MERCHANTS,
    )


def test_six_calls_in_a_minute(spark):
    rows = None
    for i in range(6):
        one = txn(spark, txn_id=f"t{i}", amount_minor=10000, txn_timestamp=f"2025-06-16T14:30:{i * 10:02d}Z")
        rows = one if rows is None else rows.unionByName(one)
    scored = flow.score_transactions(rows, merchants(spark), now())
    assert [r[0] for r in scored.orderBy("txn_id").select("txn_count_1min").collect()] == [1, 2, 3, 4, 5, 6]


def test_row_without_id_takes_fallback(spark):
    row = flow.score_transactions(txn(spark, txn_id=None), merchants(spark), now()).first()
    assert (row["risk_score"], row["score_source"], row["decision"]) == (600, "fallback", 3)


def test_merchant_scores(spark):
    ids = spark.createDataFrame([(m,) for m in ("a", "b", "c", "M_RISKY_001")], "merchant_id string")
    table = spark.createDataFrame(
        [("a", "0.2", 1), ("b", "abc", 1), ("a", "0.7", 2)], "merchant_id string, risk_score string, updated_at long"
    )
    got = {r["merchant_id"]: r["merchant_risk"] for r in joins.with_merchant_risk(ids, table, fv.MERCHANT_OVERRIDES).collect()}
    assert got == {"a": 0.7, "b": 0.5, "c": 0.5, "M_RISKY_001": 0.9}


def test_frames(spark):
    values = [b"", b"\0\0\0\0", b"\x01\0\0\0\x07{}", b"\0\0\0\1\0{}"]
    df = spark.createDataFrame([(bytearray(v),) for v in values], "value binary")
    got = frames.triage(df).collect()
    assert [r["reason"] for r in got] == [
        "message too short (0 bytes)", "message too short (4 bytes)", "invalid Confluent magic byte: 0x01", None,
    ]
    assert (got[3]["schema_id"], bytes(got[3]["payload"])) == (256, b"{}")
    engine = frames.triage(df, "transactions").collect()
    assert engine[1]["reason"] == "message too short: 4 bytes"


def test_txn_id_is_repeatable_uuid(spark):
    df = spark.createDataFrame([("k", 5), ("k", 5), ("k", 6)], "k string, ms long")
    ids = [r[0] for r in df.select(C.txn_id_for(F.col("k"), F.col("ms"))).collect()]
    assert ids[0] == ids[1] != ids[2]
    assert df.select(C.txn_id_for(F.col("k"), F.col("ms")).rlike(validation.UUID)).first()[0]
