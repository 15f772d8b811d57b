"""Row classifications: dormancy status, operation type, bots, countries, categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailspark.schema import (
    BOT_MARK,
    FLAG_ACTIVE,
    FLAG_DORMANT,
    LEVEL_CRITICAL,
    LEVEL_HIGH,
    LEVEL_LOW,
    LEVEL_MEDIUM,
    STATUS_LOW,
    STATUS_NONE,
    STATUS_WATCH,
    SUSPICIOUS_COUNTRIES,
)

# Words that mark an operation type, tried in this order.
OPERATION_WORDS = {
    "create": ("create", "add", "invite", "install"),
    "remove": ("destroy", "remove", "delete", "uninstall"),
    "modify": ("update", "change", "rename", "transfer", "config"),
}
OTHER_OPERATION = "access"


def contains_bot_mark(actor: Column) -> Column:
    return actor.contains(BOT_MARK)


def ends_with_bot_mark(actor: Column) -> Column:
    return actor.endswith(BOT_MARK)


def operation_type(action: Column) -> Column:
    """First operation type with a word inside the action (so ``uninstall`` is a create)."""
    chain = F
    for name, words in OPERATION_WORDS.items():
        chain = chain.when(action.rlike("|".join(words)), F.lit(name))
    return chain.otherwise(F.lit(OTHER_OPERATION))


def dormancy_status(count: Column, threshold: int) -> Column:
    return (
        F.when(count == 0, F.lit(STATUS_NONE))
        .when(count <= threshold // 2, F.lit(STATUS_LOW))
        .otherwise(F.lit(STATUS_WATCH))
    )


def activity_flag(count: Column, threshold: int) -> Column:
    return F.when(count <= threshold, F.lit(FLAG_DORMANT)).otherwise(F.lit(FLAG_ACTIVE))


def risk_level(score: Column) -> Column:
    return (
        F.when(score == 0, F.lit(LEVEL_LOW))
        .when(score < 50, F.lit(LEVEL_MEDIUM))
        .when(score < 100, F.lit(LEVEL_HIGH))
        .otherwise(F.lit(LEVEL_CRITICAL))
    )


def is_suspicious_country(code: Column, countries: Sequence[str] = SUSPICIOUS_COUNTRIES) -> Column:
    return F.coalesce(code.isin(*countries), F.lit(False))


def in_category(actor: Column, prefix: str) -> Column:
    return F.coalesce(actor.startswith(prefix), F.lit(False))
