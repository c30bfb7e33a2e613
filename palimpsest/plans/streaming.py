"""Streams over ``events``, run to the end of what is there."""

from __future__ import annotations


from palimpsest.operators.store import shared_folder
from palimpsest.registry import register
from palimpsest.streaming import events as E


register("R1_trace_stream", lambda s, d: E.run_to_table(E.changes(E.event_stream(s, d)), shared_folder(s, "streams")), "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type")
register("R2_windowed_progress", lambda s, d: E.run_to_table(E.windowed_counts(E.event_stream(s, d)), shared_folder(s, "streams"), "complete"), "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
