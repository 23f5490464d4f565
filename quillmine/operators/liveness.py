"""Liveness under conditions: a node lives if it is a root, or if all that one of its rules asks for lives.

A method that is called by name lives only if its class lives too, so reachability is not enough: rules have bodies of
several nodes. The fixpoint counts, for every rule, how many nodes of its body live; each round only the nodes that have
just come to life are joined with the bodies, and a rule whose count reaches its body's size brings its head to life. A
round's work is what is new in it; rounds end when nothing is.

Cases: a rule's body is a set, so a node asked for twice counts once; a rule with an empty body makes its head a root;
nodes that need each other stay dead; rules whose head is null are none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import ROUNDS, cut


def living(rules: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, round) of all that lives; rules (head, body array), roots (node)."""
    numbered = rules.where("head IS NOT NULL").select("head", F.array_sort(F.array_distinct(F.coalesce("body", F.array().cast(rules.schema["body"].dataType)))).alias("body")).distinct()
    # a rule is a number, given once as this is written, so 8 bytes of it travel
    numbered = numbered.withColumn("rule", F.monotonically_increasing_id())
    whole = cut(numbered.select("rule", "head", F.size("body").alias("size"), F.explode_outer("body").alias("node")))
    free = whole.where("size = 0").select(F.col("head").alias("node"))
    asks = whole.where("size > 0")
    single, asks = asks.where("size = 1").select("head", "node"), asks.where("size > 1")
    fresh = cut(roots.select("node").where("node IS NOT NULL").unionByName(free).distinct())
    alive = cut(fresh.select("node", F.lit(0).alias("round")))
    met = None
    for k in range(1, ROUNDS):
        # a rule with one node in its body is met at once, only the others are counted
        step = asks.join(fresh, "node").select("rule", "head", "size", F.lit(1).alias("have"))
        met = step if met is None else met.unionByName(step)
        met = cut(met.groupBy("rule", "head", "size").agg(F.sum("have").cast("int").alias("have")))
        heads = met.where("have = size").select(F.col("head").alias("node")).unionByName(single.join(fresh, "node").select(F.col("head").alias("node")))
        fresh = cut(heads.distinct().join(alive.select("node"), "node", "left_anti"))
        if fresh.isEmpty():
            return alive
        met = met.where("have < size")
        alive = alive.unionByName(fresh.select("node", F.lit(k).alias("round")))
        if k % 16 == 0:
            alive = cut(alive)
    raise RuntimeError(f"no end after {ROUNDS} rounds")


def dead(rules: DataFrame, roots: DataFrame) -> DataFrame:
    """(node) of the heads that do not live."""
    return rules.where("head IS NOT NULL").select(F.col("head").alias("node")).distinct().join(living(rules, roots).select("node"), "node", "left_anti")
