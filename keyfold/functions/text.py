"""Text formats (B12 alert_text, B13 metric_name, B14 alert_route)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Alert title and metric caller name are deployment settings (the service
# uses its own product name); the defaults here are neutral.
ALERT_TITLE = "Pipeline Alert"
METRICS_CALLER = "keyfold"

# fixed values: alert descriptions and formats
ALERT_DESC_DEAD_LETTER = "Dead Letter Queue"
ALERT_DESC_UNPROCESSED = "Unprocessed Requests"
ALERT_FMT_DEAD_LETTER = "%s:\n%s"
ALERT_FMT_UNPROCESSED = "%d requests found since:\n%s"

# fixed value: metric names ending like this are dropped by the exporter
METRIC_EXCLUDE_PATTERN = "^.*tsdb$"


def dead_letter_alert(msg_type: Column, msg_id: Column) -> Column:
    return F.format_string(ALERT_FMT_DEAD_LETTER, msg_type, msg_id)


def unprocessed_alert(n: Column, since_text: Column) -> Column:
    return F.format_string(ALERT_FMT_UNPROCESSED, n.cast("int"), since_text)


def metric_name(name: Column, kind: str, caller: str = METRICS_CALLER) -> Column:
    """``caller:name_kind`` with kind in count / gauge / histogram."""
    return F.concat(F.lit(caller + ":"), name, F.lit("_" + kind))


def alert_route(alert_channel: Column, test_channel: Column) -> Column:
    """The alert channel if set, else the test channel, else none."""
    blank_to_null = lambda c: F.when(F.length(F.trim(c)) > 0, c)
    return F.coalesce(blank_to_null(alert_channel), blank_to_null(test_channel))
