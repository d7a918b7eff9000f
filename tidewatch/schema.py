"""Table schemas and allowed values."""

from __future__ import annotations

from pyspark.sql import types as T

# The names used in stored data.
EVENT_TYPES = (
    "view", "click", "search", "purchase", "comment",
    "login", "logout", "register", "favorite", "share",
)
USER_STATUSES = ("active", "inactive", "suspended", "deleted")
RISK_LEVELS = ("low", "medium", "high")
TAG_SOURCES = ("AUTO", "MANUAL", "AUDIT", "RULE", "IMPORT")
AUDIT_STATUSES = ("pending", "in_review", "approved", "rejected", "closed")
AUDIT_LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
ACTION_TYPES = ("TAG_USER", "TRIGGER_AUDIT", "SEND_NOTIFICATION", "BLOCK_USER", "ALERT")
LOGIN_FAILURE_STATUSES = ("fail", "failed", "error")


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_STRING, _LONG, _INT = T.StringType(), T.LongType(), T.IntegerType()
_DOUBLE, _BOOL, _TIME = T.DoubleType(), T.BooleanType(), T.TimestampType()

EVENTS = _struct(
    ("event_id", _STRING), ("user_id", _STRING), ("event_type", _STRING), ("timestamp", _TIME),
    ("session_id", _STRING), ("page_url", _STRING), ("referrer", _STRING),
    ("user_agent", _STRING), ("ip_address", _STRING), ("properties", _STRING),
)
EVENT_LOG = T.StructType([
    *EVENTS.fields,
    T.StructField("event_date", T.DateType(), True),
    T.StructField("ingested_at", _TIME, True),
])
ALERTS = _struct(
    ("alert_id", _STRING), ("alert_type", _STRING), ("user_id", _STRING), ("severity", _STRING),
    ("message", _STRING), ("trigger_data", _STRING), ("timestamp", _TIME), ("resolved", _BOOL),
    ("event_id", _STRING),
)
ACTION = _struct(
    ("type", _STRING), ("params", _STRING), ("async_exec", _BOOL),
    ("retry_count", _INT), ("retry_delay", _DOUBLE),
)
RULES = _struct(
    ("id", _STRING), ("name", _STRING), ("description", _STRING), ("condition", _STRING),
    ("priority", _INT), ("enabled", _BOOL), ("actions", T.ArrayType(ACTION)),
    ("tags", T.ArrayType(_STRING)), ("created_at", _TIME), ("updated_at", _TIME),
    ("created_by", _STRING), ("version", _INT), ("load_order", _INT),
)
TAG_CHANGES = _struct(
    ("user_id", _STRING), ("tag_name", _STRING), ("value", _STRING), ("source", _STRING),
    ("confidence", _DOUBLE), ("expire_at", _TIME), ("ts", _TIME), ("deleted", _BOOL),
    ("seq", _LONG),
)
PROFILES = _struct(
    ("user_id", _STRING), ("basic_info", _STRING), ("behavior_tags", T.ArrayType(_STRING)),
    ("stat_tags", _STRING), ("predict_tags", _STRING), ("risk_level", _STRING),
    ("create_time", _TIME), ("update_time", _TIME),
)
ORDERS = _struct(
    ("id", _STRING), ("user_id", _STRING), ("rule_id", _STRING), ("trigger_data", _STRING),
    ("audit_level", _STRING), ("status", _STRING), ("assignee", _STRING),
    ("reviewer_note", _STRING), ("create_time", _TIME), ("update_time", _TIME),
)
REQUESTS = _struct(
    ("order_id", _STRING), ("seq", _LONG), ("action", _STRING), ("status", _STRING),
    ("assignee", _STRING), ("note", _STRING), ("request_time", _TIME),
)
