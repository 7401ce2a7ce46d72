import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tillwatch.functions import columns as C


def one(spark, value, *cols, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return tuple(df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


@pytest.mark.parametrize(
    "pan,masked",
    [
        ("4111 1111-1111 1111", "411111XXXXXX1111"),
        ("1234567890", "XXXXXXXXXX"),
        ("12345678901", "123456X8901"),
        ("abc", ""),
    ],
)
def test_mask_pan(spark, pan, masked):
    assert one(spark, pan, C.mask_pan(F.col("x"))) == (masked,)


def test_mask_last4(spark):
    assert one(spark, "x991234", C.mask_last4(F.col("x"))) == ("XXXXXXXXXXXX1234",)
    assert one(spark, "12", C.mask_last4(F.col("x"))) == ("XXXXXXXXXXXX12",)


@pytest.mark.parametrize("secret", ["s", "k" * 64, "long " * 30])
def test_card_hash_is_hmac(spark, secret):
    inner = hashlib.sha256(b"4111111111111111").digest()
    expected = hmac.new(secret.encode(), inner, hashlib.sha256).hexdigest()
    x = F.col("x")
    got = one(
        spark, "4111-1111 1111 1111",
        C.card_hash(x, secret),
        C.hash_matches(x, F.lit(expected.upper()), secret),
        C.hash_matches(x, F.lit("zz"), secret),
    )
    assert got == (expected, True, False)


def test_card_hash_needs_secret(spark):
    with pytest.raises(ValueError):
        C.card_hash(F.lit("1"), "")


@pytest.mark.parametrize(
    "text,millis",
    [
        ("2025-06-15T14:30:00Z", 1749997800000),
        ("2025-06-15T14:30:00.250Z", 1749997800250),
        ("2025-06-15T18:30:00+04:00", 1749997800000),
        ("2025-06-15", None),
        ("2025-06-15 14:30:00Z", None),
        ("2025-06-15T14:30:00", None),
        ("2025-13-15T14:30:00Z", None),
        ("2025-06-15T14:30:00Z\n", None),
        ("", None),
    ],
)
def test_parse_ts(spark, text, millis):
    assert one(spark, text, F.unix_millis(C.parse_ts(F.col("x")))) == (millis,)


def test_blank_knows_unicode_space(spark):
    for text, blank in [("", True), (" \t\n", True), ("  ", True), (" x ", False)]:
        assert one(spark, text, C.is_blank(F.col("x"))) == (blank,)


def test_labels(spark):
    x = F.col("x")
    got = one(spark, 9, C.transaction_type_label(x), C.channel_label(x), C.scheme_label(x), C.status_label(x), kind="int")
    assert got == ("unknown", "unknown", "unknown", "UNKNOWN")
    assert one(spark, 2, C.status_label(x), C.scheme_label(x), kind="int") == ("DECLINED", "visa")


def test_normalise_edges(spark):
    x = F.col("x")
    assert one(spark, 0, C.norm_log10(x, 1000.0), C.norm_log10(x, 1.0), C.norm_linear_cap(x, 0.0), kind="long") == (0.0, 0.0, 0.0)
    assert one(spark, 10**13, C.norm_log10(x, 999999999999.0), C.norm_linear_cap(x, 20.0), kind="long") == (1.0, 1.0)
    assert one(spark, -0.5, C.norm_passthrough(x), C.norm_binary(x), kind="double") == (0.0, 0.0)
    assert one(spark, 1.5, C.normalise(x, "no such method"), kind="double") == (1.0,)
