"""Request and row checks. Every failure is reported, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed_values as fv

FOUR_DIGITS = r"^[0-9]{4}\z"


def _quoted(col: Column) -> Column:
    """Text in double quotes with the usual escapes."""
    text = F.regexp_replace(col, r'([\\"])', r"\\$1")
    for raw, escaped in (("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t")):
        text = F.regexp_replace(text, raw, escaped)
    return F.concat(F.lit('"'), text, F.lit('"'))


def request_checks() -> dict[str, tuple[Column, Column]]:
    """Check name -> (fails when, message). The order is the reporting order."""
    c = F.col
    fails = {
        "idempotency_key": C.is_blank(c("idempotency_key")),
        "card_hash": C.is_blank(c("card_hash")),
        "pan_last4": ~c("pan_last4").rlike(FOUR_DIGITS),
        "amount": ~c("amount_minor").between(fv.AMOUNT_MIN, fv.AMOUNT_MAX),
        "currency": ~F.upper("currency").isin(fv.SUPPORTED_CURRENCIES),
        "transaction_type": c("transaction_type") == 0,
        "channel": c("channel") == 0,
        "mcc": (c("mcc") != "") & ~c("mcc").rlike(FOUR_DIGITS),
        "terminal_id": F.octet_length("terminal_id") > fv.TERMINAL_ID_MAX,
        "merchant_id": F.octet_length("merchant_id") > fv.MERCHANT_ID_MAX,
    }
    texts = {name: F.lit(text) for name, text in fv.CHECK_TEXTS.items()}
    texts["currency"] = F.concat(texts["currency"], _quoted(c("currency")))
    return {name: (bad, texts[name]) for name, bad in fails.items()}


def with_failures(requests: DataFrame) -> DataFrame:
    """Add ``failures`` (ordered messages) and ``error`` (joined text, NULL if valid).

    Where requests carry their time in ``ts``, a missing one is a failure too.
    """
    checks = list(request_checks().values())
    if "ts" in requests.columns:
        checks.append((F.col("ts").isNull(), F.lit("ts: required")))
    df = requests.withColumn("failures", C.texts_where(checks))
    return df.withColumn(
        "error",
        F.when(
            F.size("failures") > 0,
            F.concat(F.lit("validation failed: "), F.concat_ws("; ", "failures")),
        ),
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("error").isNull()).drop("failures", "error")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("error").isNotNull())


def optional_format_failures(df: DataFrame) -> DataFrame:
    """Declared but unenforced formats: RRN digits and the type / channel allow-lists."""
    checks = [
        (~F.col("rrn").rlike(r"^[0-9]{12}\z"), "rrn: does not match pattern ^[0-9]{12}$"),
        (~C.transaction_type_label(F.col("transaction_type")).isin(fv.ALLOWED_TYPES), "transaction_type: not allowed"),
        (~C.channel_label(F.col("channel")).isin(fv.ALLOWED_CHANNELS), "channel: not allowed"),
    ]
    return df.withColumn("format_failures", C.texts_where([(bad, F.lit(msg)) for bad, msg in checks]))


UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\z"


def constraint_reason() -> Column:
    """First stored-table constraint a row breaks, or NULL."""
    reason = F
    for name in fv.REQUIRED_COLUMNS:
        reason = reason.when(F.col(name).isNull(), F.lit(f"constraint_violation: {name} is null"))
    reason = reason.when(~F.col("txn_id").rlike(UUID), F.lit("constraint_violation: txn_id is not a uuid"))
    for name, width in fv.COLUMN_WIDTHS.items():
        reason = reason.when(F.length(name) > width, F.lit(f"constraint_violation: {name} longer than {width}"))
    return reason.when(
        ~F.col("risk_score").between(fv.SCORE_MIN, fv.SCORE_MAX),
        F.lit(f"constraint_violation: risk_score outside {fv.SCORE_MIN}..{fv.SCORE_MAX}"),
    )


def with_constraint_reason(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reason", constraint_reason())
