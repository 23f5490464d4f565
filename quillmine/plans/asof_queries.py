"""Queries of the as-of join and of Thompson sampling over whole events, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof as A
from ..operators import sampling as T
from .bindings import NOW, OBS, observations, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def changes(s, d):
    """What changes a user's key: every event, by its time in microseconds."""
    e = table(s, d, "events").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("order"), F.struct("event_type", "value").alias("value"), "event_type")
    return e


def asof_last_purchase(s, d):
    """To every event, the user's last purchase at or before it."""
    e = changes(s, d)
    rows = e.select("key", "at", F.col("order").alias("event_id"))
    found = A.last_before(rows, e.where("event_type = 'purchase'").drop("event_type"), slices=16)
    return found.select("event_id", F.col("key").alias("user_id"), F.col("change.order").alias("purchase_id"), F.col("change.value.value").alias("value"))


def consistency_sweep(s, d):
    """Every observation against the events of the user with its number: what it had seen when written, and whether something came since."""
    notes = observations(s, d).select("id", F.col("id").alias("key"), (F.col("created_at_epoch") * 1_000_000).alias("at"))
    log = changes(s, d).select("key", "at", "order", F.col("order").alias("value"))
    return A.consistency(notes, log, NOW * 1_000_000, slices=16).select("id", F.col("seen").alias("seen_event"), F.col("now").alias("now_event"), "stale")


def outcomes(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("key"), (F.get_json_object("props", "$.k").cast("long") % 4).alias("level"), (F.col("value") > 100).alias("ok"))


def thompson_posteriors(s, d):
    return T.posteriors(outcomes(s, d))


def thompson_levels(s, d):
    return T.choose(T.posteriors(outcomes(s, d)), 42)


QUERIES |= {"asof_last_purchase": asof_last_purchase, "consistency_sweep": consistency_sweep, "thompson_posteriors": thompson_posteriors, "thompson_levels": thompson_levels}
ORACLES["asof_last_purchase"] = """WITH p AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase')
SELECT e.event_id, e.user_id, arg_max(p.event_id, (p.ts, p.event_id)) AS purchase_id, arg_max(p.value, (p.ts, p.event_id)) AS value FROM events e LEFT JOIN p ON p.user_id = e.user_id AND p.ts <= e.ts GROUP BY e.event_id, e.user_id"""
ORACLES["consistency_sweep"] = f"""WITH {OBS}, c AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE ts IS NOT NULL)
SELECT o.id, arg_max(event_id, (t, event_id)) FILTER (t <= created_at_epoch * 1000000) AS seen_event, arg_max(event_id, (t, event_id)) FILTER (t <= {NOW}000000) AS now_event,
coalesce(max(t) FILTER (t <= {NOW}000000) > any_value(created_at_epoch) * 1000000, false) AS stale FROM obs o LEFT JOIN c ON c.user_id = o.id GROUP BY o.id"""
ORACLES["thompson_posteriors"] = """WITH o AS (SELECT user_id AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS level, value > 100 AS ok FROM events WHERE user_id IS NOT NULL)
SELECT key, l AS level, 1 + count(*) FILTER (level = l AND ok) AS alpha, 1 + count(*) FILTER (level = l AND NOT ok) AS beta FROM o, (VALUES (0), (1), (2), (3)) v(l) GROUP BY key, l"""
