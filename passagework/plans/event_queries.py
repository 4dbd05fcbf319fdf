"""Event-time queries: events arrive in two parts, a fiftieth of the first part's with the second one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from ..streaming import event_time
from .registry import PARTS, query

#: The rows of the first part. What is older and not among them comes late.
CUT = "TIMESTAMP '2024-01-20 00:00:00'"
FIRST = f"ts <= {CUT} AND event_id % 50 <> 7"

PARTS["marks"] = f"""SELECT (SELECT date_trunc('milliseconds', max(ts)) FROM events WHERE {FIRST}) - INTERVAL 2 HOUR AS first_mark,
(SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 2 HOUR AS last_mark"""
_TIMES = "strftime(window_start, '%Y-%m-%d %H:%M:%S.%f') AS window_start, strftime(window_end, '%Y-%m-%d %H:%M:%S.%f') AS window_end"


def _parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    first = f"coalesce({FIRST.replace(CUT, CUT.replace('TIMESTAMP', 'TIMESTAMP_NTZ'))}, false)"
    return [events.where(first), events.where(f"not {first}")]


def _windows_sql(starts: str, hours: int) -> str:
    return f"""SELECT {_TIMES}, event_type, n, total FROM (
SELECT window_start, window_start + INTERVAL {hours} HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (
SELECT *, {starts} AS window_start FROM events, marks WHERE ts IS NOT NULL)
WHERE coalesce({FIRST}, false) OR window_start + INTERVAL {hours} HOUR > first_mark GROUP BY ALL), marks WHERE window_end <= last_mark"""


@query(_windows_sql("date_trunc('hour', ts)", 1))
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour; rows whose hour is over by the watermark are dropped."""
    return event_time.arriving(spark, _parts(spark, sf_dir), lambda e: event_time.windows(e, "event_type", "1 hour"))


@query(_windows_sql("unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR])", 2))
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type in two hours, every hour."""
    return event_time.arriving(spark, _parts(spark, sf_dir), lambda e: event_time.windows(e, "event_type", "2 hours", "1 hour"))


def _islands(rows: str) -> str:
    return f"""SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (
SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS new FROM {rows})"""


# Sessions that were over by the first watermark are done; what is left goes on with the rows that come and aren't late.
PARTS["early_rows"] = _islands(f"(SELECT * FROM events WHERE ts IS NOT NULL AND {FIRST})")
PARTS["early_sessions"] = """SELECT user_id, island, min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, count(*) AS n, round(sum(value), 2) AS total
FROM early_rows GROUP BY user_id, island"""
PARTS["later_rows"] = _islands(f"""(SELECT event_id, ts, user_id, value FROM early_rows JOIN early_sessions USING (user_id, island), marks WHERE window_end > first_mark
UNION ALL SELECT event_id, ts, user_id, value FROM events, marks WHERE ts IS NOT NULL AND NOT coalesce({FIRST}, false) AND ts + INTERVAL 30 MINUTE > first_mark)""")


@query(f"""SELECT {_TIMES}, user_id, n, total FROM (
SELECT user_id, window_start, window_end, n, total FROM early_sessions, marks WHERE window_end <= first_mark
UNION ALL SELECT user_id, min(ts), max(ts) + INTERVAL 30 MINUTE, count(*), round(sum(value), 2) FROM later_rows GROUP BY user_id, island), marks WHERE window_end <= last_mark""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events without a pause of half an hour."""
    return event_time.arriving(spark, _parts(spark, sf_dir), lambda e: event_time.sessions(e, "user_id"))


@query(f"SELECT DISTINCT event_id FROM events WHERE ts IS NOT NULL AND {FIRST}")
def events_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part arrives twice: repetitions inside the watermark are known, older ones are late."""
    first = _parts(spark, sf_dir)[0]
    return event_time.arriving(spark, [first, first], lambda e: event_time.once(e, "event_id"))
