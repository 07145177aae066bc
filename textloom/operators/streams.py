"""Batch runs of the streaming aggregations."""

from textloom.registry import query
from textloom.streaming import activity as A


@query("stream_activity_windows", "activity", oracle="select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, action_type, count(*)::bigint as n, round(sum(value), 6) as total from activity group by 1, 2")
def activity_windows(activity):
    return A.windows(activity)
