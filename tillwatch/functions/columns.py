"""Column functions shared by the batch and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv


def present(col: Column, default) -> Column:
    """Absent values read as '' or 0, so rules never meet NULL."""
    return F.coalesce(col, F.lit(default))


def is_blank(col: Column) -> Column:
    """True for '' and for any run of Unicode white space."""
    return ~col.rlike(r"(?U)\S")


def texts_where(pairs: list[tuple[Column, Column]]) -> Column:
    """Array of the texts whose condition holds, in order. No lambda, so it compiles."""
    none = F.array().cast("array<string>")
    parts = [F.when(condition, F.array(text)).otherwise(none) for condition, text in pairs]
    return F.concat(*parts) if parts else none


# --- card numbers --------------------------------------------------------------


def strip_non_digits(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def mask_pan(pan: Column, prefix: int = 6, suffix: int = 4, mask: str = "X") -> Column:
    """First ``prefix`` and last ``suffix`` digits; short numbers are masked whole."""
    digits = strip_non_digits(pan)
    length = F.length(digits)
    hidden = length - F.lit(prefix + suffix)
    return F.when(hidden <= 0, F.repeat(F.lit(mask), length)).otherwise(
        F.concat(
            F.substring(digits, 1, prefix),
            F.repeat(F.lit(mask), hidden),
            F.right(digits, F.lit(suffix)),
        )
    )


def mask_last4(last4: Column, suffix: int = 4, mask: str = "X") -> Column:
    digits = strip_non_digits(last4)
    return F.concat(F.lit(mask * (16 - suffix)), F.right(digits, F.lit(suffix)))


def card_hash(pan: Column, secret: str) -> Column:
    """HMAC-SHA256(secret, SHA-256(digits)) as lower-case hex.

    HMAC is two nested SHA-256 calls over padded keys, so it stays in the JVM.
    """
    if not secret:
        raise ValueError("the tokenisation secret must not be empty")
    key = secret.encode("utf-8")
    if len(key) > 64:
        import hashlib

        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner_pad = F.lit(bytes(b ^ 0x36 for b in key))
    outer_pad = F.lit(bytes(b ^ 0x5C for b in key))

    def sha(data: Column) -> Column:
        return F.unhex(F.sha2(data, 256))

    message = sha(strip_non_digits(pan).cast("binary"))
    return F.sha2(F.concat(outer_pad, sha(F.concat(inner_pad, message))), 256)


def hash_matches(pan: Column, candidate: Column, secret: str) -> Column:
    """Hex digits compare without case; text that is not hex never matches."""
    return F.coalesce(card_hash(pan, secret) == F.lower(candidate), F.lit(False))


def txn_id_for(idempotency_key: Column, ms: Column) -> Column:
    """UUID-shaped id derived from the request, so a replay assigns the same one."""
    digest = F.sha2(F.concat_ws("|", idempotency_key, ms.cast("string")), 256)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("4"), F.substring(digest, 14, 3)),
        F.concat(F.lit("a"), F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


# --- time ----------------------------------------------------------------------

RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z"


def parse_ts(text: Column, fallback: Column | None = None) -> Column:
    """RFC 3339 text to a timestamp; anything else gives ``fallback`` (NULL if none)."""
    parsed = F.when(text.rlike(RFC3339), F.try_to_timestamp(F.translate(text, ",", ".")))
    return parsed if fallback is None else F.coalesce(parsed, fallback)


def format_ts(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# --- labels --------------------------------------------------------------------


def label(code: Column, labels: dict[int, str], default: str) -> Column:
    out = F
    for key, text in labels.items():
        out = out.when(code == key, F.lit(text))
    return out.otherwise(F.lit(default))


def transaction_type_label(code: Column) -> Column:
    return label(code, fv.TRANSACTION_TYPES, "unknown")


def channel_label(code: Column) -> Column:
    return label(code, fv.CHANNELS, "unknown")


def scheme_label(code: Column) -> Column:
    return label(code, fv.SCHEMES, "unknown")


def status_label(decision: Column) -> Column:
    """Stored status; the stored decision carries the same text."""
    return label(decision, fv.STATUS_LABELS, "UNKNOWN")


# --- normalisation to [0, 1] ---------------------------------------------------


def _clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def norm_log10(value: Column, cap: float) -> Column:
    if cap <= 1:
        return F.lit(0.0)
    safe = F.greatest(value.cast("double"), F.lit(1.0))
    return _clamp01(F.log10(safe) / F.log10(F.lit(float(cap))))


def norm_linear_cap(value: Column, cap: float) -> Column:
    if cap == 0:
        return F.lit(0.0)
    return _clamp01(F.least(value.cast("double"), F.lit(float(cap))) / F.lit(float(cap)))


def norm_binary(value: Column) -> Column:
    return F.when(value > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def norm_passthrough(value: Column) -> Column:
    return _clamp01(value.cast("double"))


def normalise(value: Column, method: str, cap: float | None = None) -> Column:
    """Unknown methods pass the value through, clamped."""
    if method == "log10":
        return norm_log10(value, cap or 0.0)
    if method == "linear_cap":
        return norm_linear_cap(value, cap or 0.0)
    if method == "binary":
        return norm_binary(value)
    return norm_passthrough(value)
