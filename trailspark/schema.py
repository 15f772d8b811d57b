"""Table schemas and the fixed value lists the analyses look for."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("date_jst", T.TimestampNTZType()),
    T.StructField("action", T.StringType()),
    T.StructField("actor", T.StringType()),
    T.StructField("org", T.StringType()),
    T.StructField("repo", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("team", T.StringType()),
    T.StructField("actor_ip", T.StringType()),
    T.StructField("country_code", T.StringType()),
    T.StructField("actor_is_bot", T.BooleanType()),
    T.StructField("_source_path", T.StringType()),  # tells files apart
    T.StructField("_source_file", T.StringType()),  # for display
    T.StructField("_source_bytes", T.LongType()),
])

MEMBER_SCHEMA = T.StructType([
    T.StructField("login", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("site_admin", T.BooleanType()),
])

SEAT_SCHEMA = T.StructType([
    T.StructField("login", T.StringType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("org_name", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("last_activity_at", T.TimestampNTZType()),
    T.StructField("last_activity_editor", T.StringType()),
    T.StructField("pending_cancellation_date", T.TimestampNTZType()),
])

_ACCOUNT = T.StructType([
    T.StructField("login", T.StringType()),
    T.StructField("id", T.LongType()),
])

SEAT_DOCUMENT_SCHEMA = T.StructType([
    T.StructField("total_seats", T.LongType()),
    T.StructField("seats", T.ArrayType(T.StructType([
        T.StructField("created_at", T.StringType()),
        T.StructField("pending_cancellation_date", T.StringType()),
        T.StructField("last_activity_at", T.StringType()),
        T.StructField("last_activity_editor", T.StringType()),
        T.StructField("assignee", _ACCOUNT),
        T.StructField("organization", _ACCOUNT),
    ]))),
])

# Fixed values. They must equal the values users of such reports know, so they are
# listed as they are; every function that uses a list takes another one as argument.
CRITICAL_ACTIONS = (
    "repo.destroy",
    "repo.archived",
    "repo.change_visibility",
    "org.remove_member",
    "team.destroy",
    "hook.create",
    "hook.destroy",
    "protected_branch.destroy",
    "secret_scanning.disable",
)
HIGH_RISK_ACTIONS = (
    "org.add_billing_manager",
    "org.promote_member_to_owner",
    "deploy_key.create",
    "integration_installation.create",
)
PROFILE_RISK_ACTIONS = (
    "repo.destroy",
    "repo.transfer",
    "repo.access",
    "org.remove_member",
    "org.update_member",
    "team.destroy",
    "team.remove_member",
    "hook.config_changed",
    "hook.destroy",
    "secret_scanning.disable",
    "protected_branch.destroy",
    "protected_branch.policy_override",
    "business.remove_admin",
)
SUSPICIOUS_COUNTRIES = ("RU", "CN", "KP")
WEEKDAY_NAMES = ("月", "火", "水", "木", "金", "土", "日")
UNKNOWN_WEEKDAY = "不明"
STATUS_NONE, STATUS_LOW, STATUS_WATCH = "完全休眠", "低活動", "要観察"
FLAG_DORMANT, FLAG_ACTIVE = "休眠", "アクティブ"
TREND_ALL, TREND_DORMANT = "全ユーザー", "休眠ユーザー"
LEVEL_LOW, LEVEL_MEDIUM, LEVEL_HIGH, LEVEL_CRITICAL = "低リスク", "中リスク", "高リスク", "重大リスク"
UNKNOWN = "unknown"
BOT_MARK = "[bot]"
OPENING_HOUR, CLOSING_HOUR = 9, 18
