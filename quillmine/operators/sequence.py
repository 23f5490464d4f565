"""Sequence models over a call log (session, seq order ts/id, state), and bandit scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import dot
from . import dense
from .graph import cut


def transitions(calls: DataFrame) -> DataFrame:
    """(state, next, n, p) of successive calls in a session; calls: session, ord, state."""
    order = Window.partitionBy("session").orderBy("ord")
    pairs = calls.select("state", F.lead("state").over(order).alias("next")).where("next IS NOT NULL")
    counts = pairs.groupBy("state", "next").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("state")), 6))


def predict(calls: DataFrame, k: int = 3) -> DataFrame:
    """The k likeliest next states of each state."""
    place = F.row_number().over(Window.partitionBy("state").orderBy(F.desc("n"), "next"))
    return transitions(calls).withColumn("place", place).where(F.col("place") <= k)


def beam(calls: DataFrame, start: str, width: int = 3, depth: int = 3, least: float = 0.15) -> DataFrame:
    """(path, p): the width likeliest continuations of start, each step of probability least or more; dead ends stay."""
    steps = predict(calls, width).where(F.col("p") >= least).select(F.col("state").alias("last"), "next", F.col("p").alias("step"))
    top = lambda df: df.orderBy(F.desc("p"), F.array_join("path", ">")).limit(width)
    now = top(steps.where(F.col("last") == start).select(F.array("next").alias("path"), F.col("step").alias("p")))
    for _ in range(depth - 1):
        grown = now.withColumn("last", F.element_at("path", -1)).join(steps, "last", "left")
        path = F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.array("next")))
        now = top(grown.select(path.alias("path"), (F.col("p") * F.coalesce("step", F.lit(1.0))).alias("p")))
    return now.select(F.array_join("path", ">").alias("path"), F.round("p", 6).alias("p"))


def ppm_contexts(calls: DataFrame, order: int = 2) -> DataFrame:
    """(context, next, n): counts of what follows each run of order states."""
    w = Window.partitionBy("session").orderBy("ord")
    cols = [F.lag("state", k).over(w) for k in range(order, 0, -1)]
    rows = calls.select(F.array(*cols).alias("c"), F.col("state").alias("next")).where(F.forall("c", lambda x: x.isNotNull()))
    return rows.groupBy(F.array_join("c", ">").alias("context"), "next").agg(F.count("*").alias("n"))


def ppm_predict(calls: DataFrame, order: int = 2, least: int = 3, weight: float = 0.9) -> DataFrame:
    """(context, next, p): the high-order estimate where a context was seen least times, mixed with order 1."""
    high = ppm_contexts(calls, order).withColumn("total", F.sum("n").over(Window.partitionBy("context"))).where(F.col("total") >= least)
    low = transitions(calls).select(F.col("state").alias("last"), "next", F.col("p").alias("p1"))
    high = high.withColumn("last", F.element_at(F.split("context", ">"), -1))
    mixed = weight * F.col("n") / F.col("total") + (1 - weight) * F.coalesce("p1", F.lit(0.0))
    return high.join(low, ["last", "next"], "left").select("context", "next", F.round(mixed, 6).alias("p")).where("p > 0.05")


def coactivation(activations: DataFrame) -> DataFrame:
    """(a, b, n): in how many sessions both symbols occur, a < b; activations: session, symbol."""
    distinct = activations.select("session", "symbol").distinct()
    left, right = distinct.select("session", F.col("symbol").alias("a")), distinct.select("session", F.col("symbol").alias("b"))
    return left.join(right, "session").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def npmi(activations: DataFrame, least: int = 2) -> DataFrame:
    """Normalised pointwise mutual information of co-activated symbols; the total is that of activations."""
    each = activations.select("session", "symbol").distinct().groupBy("symbol").agg(F.count("*").cast("double").alias("n"))
    total = F.broadcast(each.agg(F.sum("n").alias("total")))
    pairs = coactivation(activations).where(F.col("n") >= least).withColumnRenamed("n", "both")
    out = pairs.join(each.toDF("a", "na"), "a").join(each.toDF("b", "nb"), "b").join(total)
    joint = F.col("both") / F.col("total")
    value = F.when(joint >= 1, 1.0).otherwise(F.log(joint * F.col("total") * F.col("total") / (F.col("na") * F.col("nb"))) / -F.log(joint))
    return out.select("a", "b", F.round(value, 6).alias("npmi"))


def context_type(calls: DataFrame, lookback: int = 5) -> DataFrame:
    """Per session: edit if one of the last calls edits, else review, navigation or unknown."""
    last = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("ord"))) <= lookback
    recent = calls.withColumn("recent", last).where("recent").groupBy("session").agg(F.collect_set("state").alias("s"))
    has = lambda x: F.array_contains("s", x)
    kind = F.when(has("purchase"), "edit").when(has("search"), "review").when(has("view") | has("click"), "navigation").otherwise("unknown")
    return recent.select("session", kind.alias("context_type"))


def session_signature(calls: DataFrame, states: list[str], buckets: int = 13) -> DataFrame:
    """Per session: share of each state, then symbol counts by MD5 bucket over their maximum, as (session, dim, value)."""
    total = calls.groupBy("session").agg(F.count("*").alias("total"))
    share = calls.where(F.col("state").isin(states)).groupBy("session", "state").agg(F.count("*").alias("n")).join(total, "session")
    tools = share.select("session", F.concat(F.lit("tool:"), "state").alias("dim"), F.round(F.col("n") / F.col("total"), 6).alias("value"))
    bucket = (F.conv(F.substring(F.md5(F.col("symbol").cast("binary")), 1, 8), 16, 10).cast("long") % buckets).cast("string")
    symbols = calls.where("symbol IS NOT NULL").select("session", "symbol").distinct().groupBy("session", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    symbols = symbols.select("session", F.concat(F.lit("bucket:"), "bucket").alias("dim"), F.round(F.col("n") / F.max("n").over(Window.partitionBy("session")), 6).alias("value"))
    return tools.unionByName(symbols)


def similar_sessions(signature: DataFrame, session: int, least: float = 0.5, k: int = 3) -> DataFrame:
    """Sessions by cosine to one session's signature, over the sparse dimensions."""
    norm = signature.groupBy("session").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    own = F.broadcast(signature.where(F.col("session") == session).select("dim", F.col("value").alias("v")))
    mine = F.broadcast(norm.where(F.col("session") == session).select(F.col("norm").alias("own")))
    dots = signature.where(F.col("session") != session).join(own, "dim").groupBy("session").agg(F.sum(F.col("value") * F.col("v")).alias("dot"))
    out = dots.join(norm, "session").join(mine).select("session", F.round(F.col("dot") / (F.col("norm") * F.col("own")), 6).alias("similarity"))
    return out.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "session").limit(k)


def similar_each(signature: DataFrame, sessions: Column, least: float = 0.5, k: int = 3) -> DataFrame:
    """(query, session, similarity): similar_sessions for every session that the condition holds for. The signature has few dimensions, so rows become dense vectors."""
    names = sorted(r["dim"] for r in signature.select("dim").distinct().collect())
    parts = [F.coalesce(F.max(F.when(F.col("dim") == n, F.col("value"))), F.lit(0.0)) for n in names]
    if not names:
        return signature.select(F.col("session").alias("query"), "session", F.col("value").alias("similarity")).limit(0)
    vectors = cut(signature.groupBy("session").agg(F.array(*parts).alias("embedding")).withColumnRenamed("session", "id"))
    found = dense.top(vectors, vectors.where(sessions), k, unit=True, itself=False, least=least)
    return found.select("query", F.col("id").alias("session"), F.col("score").alias("similarity"))


def lattice(calls: DataFrame, outcome: Column) -> DataFrame:
    """Beta(1, 1) posteriors by state: mean and trials."""
    out = calls.groupBy("state").agg((1 + F.count_if(outcome)).alias("alpha"), (1 + F.count_if(~outcome)).alias("beta"))
    return out.select("state", F.round(F.col("alpha") / (F.col("alpha") + F.col("beta")), 6).alias("mean"), (F.col("alpha") + F.col("beta") - 2).alias("trials"))


def linucb_design(rows: DataFrame, features: str, reward: str) -> DataFrame:
    """(i, j, a) of A = I + sum of outer products, and with j = -1 of b = sum of reward times features."""
    x = rows.select(F.posexplode(features).alias("i", "x"), F.col(features).alias("f"), F.col(reward).alias("r"))
    outer = x.select("i", F.posexplode("f").alias("j", "y"), "x").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("a"))
    outer = outer.withColumn("a", F.col("a") + F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    b = x.groupBy("i").agg(F.sum(F.col("x") * F.col("r")).alias("a")).select("i", F.lit(-1).alias("j"), "a")
    return outer.unionByName(b).withColumn("a", F.round("a", 6))


def linucb_rank(rows: DataFrame, design: DataFrame, features: str, alpha: float = 1.0) -> DataFrame:
    """rows (id, features) with theta . f + alpha * sqrt(f' A^-1 f). The design has 10 x 11 numbers, so its inverse is the driver's."""
    import numpy as np

    cells = design.collect()
    n = max(r["i"] for r in cells) + 1
    a, b = np.eye(n), np.zeros(n)
    for r in cells:
        if r["j"] < 0:
            b[r["i"]] = r["a"]
        else:
            a[r["i"], r["j"]] = r["a"]
    inverse = np.linalg.inv(a)
    f = F.col(features)
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    spread = F.array(*[dot(f, lit(row)) for row in inverse])
    return rows.select("id", F.round(dot(f, lit(inverse @ b)) + alpha * F.sqrt(F.greatest(dot(f, spread), F.lit(0.0))), 4).alias("score"))
