"""Rule table compiled to boolean Columns.

``rule_columns`` turns a list of rule settings into ``{id: Column}``. The
built-in rules are the table in ``fixed_values.RULES``; callers may pass their
own with the same seven condition types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed_values as fv

DAY_NUMBERS = {
    "SUNDAY": 1, "MONDAY": 2, "TUESDAY": 3, "WEDNESDAY": 4,
    "THURSDAY": 5, "FRIDAY": 6, "SATURDAY": 7,
}


def threshold_for(currency: Column, thresholds: dict[str, int]) -> Column:
    """Limit of a currency: configured limits are laid over the built-in ones."""
    thresholds = {**fv.HIGH_AMOUNT_THRESHOLDS, **thresholds}
    out = F
    for code, limit in thresholds.items():
        if code != "DEFAULT":
            out = out.when(currency == code, F.lit(limit).cast("long"))
    default = F.lit(thresholds.get("DEFAULT", fv.HIGH_AMOUNT_DEFAULT)).cast("long")
    return default if out is F else out.otherwise(default)


def _amount_threshold(cond, ts, fired):
    return F.col("amount_minor") > threshold_for(F.col("currency"), cond["thresholds"])


def _round_amount(cond, ts, fired):
    amount = F.col("amount_minor")
    return (amount > cond["min_minor"]) & (amount % cond["divisible_by"] == 0)


def _mcc_list(cond, ts, fired):
    return F.col("mcc").isin(cond["mcc_codes"])


def _time_window(cond, ts, fired):
    start, end, hour = cond["start_hour_utc"], cond["end_hour_utc"], F.hour(ts)
    if start <= end:
        return (hour >= start) & (hour < end)
    return (hour >= start) | (hour < end)


def _composite(cond, ts, fired):
    out = F.lit(True)
    for needed in cond.get("requires_rules", []):
        out = out & fired.get(needed, F.lit(False))
    if cond.get("day_of_week"):
        out = out & F.dayofweek(ts).isin([DAY_NUMBERS[d] for d in cond["day_of_week"]])
    return out


def _channel_match(cond, ts, fired):
    codes = [code for code, name in fv.CHANNELS.items() if name.upper() in cond["channels"]]
    return F.col("channel").isin(codes)


def _currency_not_in(cond, ts, fired):
    return ~F.col("currency").isin(cond["domestic_currencies"])


CONDITIONS = {
    "amount_threshold": _amount_threshold,
    "round_amount": _round_amount,
    "mcc_list": _mcc_list,
    "time_window": _time_window,
    "composite": _composite,
    "channel_match": _channel_match,
    "currency_not_in": _currency_not_in,
}


def rule_columns(ts: Column, rules: list[dict] | None = None) -> dict[str, Column]:
    """Enabled rules by id, in their order. A composite may name rules listed before or after it; on a disabled
    rule it is false. Naming an unknown rule, or one that leads back, is an error."""
    listed = fv.RULES if rules is None else rules
    by_id = {rule["id"]: rule for rule in listed}
    fired: dict[str, Column] = {}

    def compiled(rule: dict, path: tuple[str, ...]) -> None:
        if rule["id"] in fired or not rule.get("enabled", True):
            return
        if rule["id"] in path:
            raise ValueError(f"rules require each other: {' > '.join([*path, rule['id']])}")
        condition = rule["condition"]
        if condition["type"] not in CONDITIONS:
            raise ValueError(f"unknown condition type {condition['type']!r} in rule {rule['id']}")
        for needed in condition.get("requires_rules", []):
            if needed not in by_id:
                raise ValueError(f"rule {rule['id']} requires the unknown rule {needed!r}")
            compiled(by_id[needed], (*path, rule["id"]))
        fired[rule["id"]] = CONDITIONS[condition["type"]](condition, ts, fired)

    for rule in listed:
        compiled(rule, ())
    return {rule["id"]: fired[rule["id"]] for rule in listed if rule["id"] in fired}


def triggered(ts: Column, rules: list[dict] | None = None) -> Column:
    """Ordered array of the ids that fired."""
    return C.texts_where([(flag, F.lit(name)) for name, flag in rule_columns(ts, rules).items()])


def points(ts: Column, rules: list[dict] | None = None) -> Column:
    """Sum of the configured points of the rules that fired (reporting only)."""
    table = fv.RULES if rules is None else rules
    contribution = {rule["id"]: rule["score_contribution"] for rule in table}
    total = F.lit(0)
    for name, flag in rule_columns(ts, table).items():
        total = total + F.when(flag, F.lit(contribution[name])).otherwise(F.lit(0))
    return total


def rule_flags(event_ts: Column) -> dict[str, Column]:
    """The three 0/1 features; an unreadable timestamp is not night."""
    night = F.coalesce((F.hour(event_ts) >= 0) & (F.hour(event_ts) < 5), F.lit(False))
    return {
        "is_night": night.cast("int"),
        "is_risky_mcc": F.col("mcc").isin(fv.RISKY_MCCS).cast("int"),
        "is_card_not_present": (F.col("channel") == 2).cast("int"),
    }


def velocity_settings(settings: dict[str, dict] | None = None) -> list[tuple[str, str, int, int]]:
    """Enabled velocity rules as (id, column, threshold, points); ``settings`` by id are laid over the
    built-in ones: enabled, threshold, score_contribution."""
    known = {name for name, *_ in fv.VELOCITY_RULES}
    given = settings or {}
    if set(given) - known:
        raise ValueError(f"no such velocity rule: {sorted(set(given) - known)}")
    rows = [(given.get(name, {}), name, column, limit, pts) for name, column, limit, pts in fv.VELOCITY_RULES]
    return [
        (name, column, own.get("threshold", limit), own.get("score_contribution", pts))
        for own, name, column, limit, pts in rows
        if own.get("enabled", True)
    ]


def velocity_triggers(settings: dict[str, dict] | None = None) -> Column:
    """Velocity rules that fire (value at or above threshold); separate from ``triggered``."""
    return C.texts_where([(F.col(col) >= limit, F.lit(name)) for name, col, limit, _ in velocity_settings(settings)])


def velocity_points(settings: dict[str, dict] | None = None) -> Column:
    """Sum of the points of the velocity rules that fire (reporting only)."""
    total = F.lit(0)
    for _, col, limit, pts in velocity_settings(settings):
        total = total + F.when(F.col(col) >= limit, F.lit(pts)).otherwise(F.lit(0))
    return total


def with_rules(txns: DataFrame, now: Column, rules: list[dict] | None = None) -> DataFrame:
    """Add ``event_ts`` and ``triggered_rules``; an unreadable timestamp counts as ``now``."""
    parsed = txns.withColumn("event_ts", C.parse_ts(F.col("txn_timestamp")))
    return parsed.withColumn("triggered_rules", triggered(F.coalesce(F.col("event_ts"), now), rules))


def rule_table(spark: SparkSession, rules: list[dict] | None = None) -> DataFrame:
    """The rule set as rows: id, kind, enabled, points."""
    rows = [
        (r["id"], r["condition"]["type"], r.get("enabled", True), r["score_contribution"])
        for r in (fv.RULES if rules is None else rules)
    ]
    if rules is None:
        rows += [(name, "velocity", True, pts) for name, _, _, pts in fv.VELOCITY_RULES]
    return spark.createDataFrame(rows, "rule_id string, kind string, enabled boolean, points int")
