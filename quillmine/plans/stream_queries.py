"""The stateful stream over whole events, and the SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import _folder
from ..streaming import sessions as N
from .bindings import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def stream_sessions(s, d):
    """Sessions that a stream of events, each id once, has closed when all events are in."""
    import uuid

    work = f"{_folder(s)}/quillmine/stream-{uuid.uuid4().hex}"
    events = N.read_events(s, f"{d}/events.parquet", table(s, d, "events").schema)
    N.drain(N.streamed(N.deduplicated(N.calls(events))), f"{work}/out", f"{work}/checkpoint")
    out = s.read.schema(N.RESULT).parquet(f"{work}/out")
    return out.withColumn("symbols", F.array_join("symbols", ","))


QUERIES["stream_sessions"] = stream_sessions
#: The stream ends with a watermark of ten minutes before the last event; a session is out when its gap has passed by then.
ORACLES["stream_sessions"] = """WITH c AS (SELECT DISTINCT ON (event_id) event_id, user_id AS user, epoch_ms(ts) AS ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS symbol FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
h AS (SELECT *, CASE WHEN ms - lag(ms) OVER w < 1800000 THEN 0 ELSE 1 END AS head FROM c WINDOW w AS (PARTITION BY user ORDER BY ms, event_id)),
n AS (SELECT *, sum(head) OVER (PARTITION BY user ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS number FROM h)
SELECT user, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS calls, coalesce(string_agg(DISTINCT symbol, ',' ORDER BY symbol), '') AS symbols FROM n GROUP BY user, number
HAVING max(ms) + 1800000 <= (SELECT max(epoch_ms(ts)) - 600000 FROM events)"""
