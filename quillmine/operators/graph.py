"""Graph operators over edges (src, dst). Each round of a loop is one join; rounds are written when a scratch folder is set."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _folder(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        path = "file://" + tempfile.mkdtemp(prefix="quillmine-")
        atexit.register(shutil.rmtree, path[7:], True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that lineage does not grow with the rounds."""
    path = f"{_folder(df.sparkSession)}/quillmine/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Arcs that one task makes distinct, about. Numbers of nodes pack so well that tasks cut by bytes would hold far more.
ARCS = 1 << 21


def plain(df: DataFrame) -> DataFrame:
    """cut(), but 8 bytes a number: a task that reads some number of bytes gets as many rows as they hold."""
    path = f"{_folder(df.sparkSession)}/quillmine/{uuid.uuid4().hex}"
    df.write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def undirected(edges: DataFrame, loops: bool = True) -> DataFrame:
    """(src, dst) of both directions of every edge, once, in files whose rows are as many as their bytes tell."""
    given = cut(edges.select("src", "dst") if loops else edges.select("src", "dst").where("src <> dst"))
    both = given.unionByName(reverse(given))
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, 2 * given.count() // ARCS + 1)
    return plain(both.repartition(parts, "dst", "src").distinct())


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


#: Rounds after which a loop is taken not to end.
ROUNDS = 10_000


def bfs(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, depth, parent) of what seeds (node) reach, within depth steps if given; the parent is the smallest of the last level."""
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct())
    seen = cut(seeds.select("node", F.lit(0).alias("depth"), F.lit(None).cast(edges.schema["src"].dataType).alias("parent")).distinct())
    level = seen
    for d in range(1, (ROUNDS if depth is None else depth) + 1):
        step = level.select(F.col("node").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        level = cut(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("depth"), "parent"))
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level)
        if d % 16 == 0:
            seen = cut(seen)
    if depth is None:
        raise RuntimeError(f"no end after {ROUNDS} rounds")
    return seen


def change_impact(edges: DataFrame, node: DataFrame, depth: int | None = None) -> DataFrame:
    """Everything that depends on node, with confidence 0.6 ** (depth - 1), 0.05 at least."""
    out = bfs(reverse(edges), node, depth).where("depth > 0")
    return out.select("node", "depth", F.round(F.greatest(F.lit(0.05), F.pow(F.lit(0.6), F.col("depth") - 1)), 6).alias("confidence"))


def call_chain(edges: DataFrame, start: DataFrame, end: int) -> DataFrame:
    """(step, node) of a shortest path; among equals, the smallest parents counted from the end."""
    tree = cut(bfs(edges, start))
    jumps, path = tree.where("parent IS NOT NULL").select("node", F.col("parent").alias("to")), tree.where(F.col("node") == end).select("node")
    while not jumps.isEmpty():
        # path has the last 2^k nodes, jumps lead over as many: the rounds are the logarithm of the depth
        path = cut(path.unionByName(path.join(jumps, "node").select(F.col("to").alias("node"))))
        jumps = cut(jumps.join(jumps.toDF("by", "further"), F.col("to") == F.col("by")).select("node", F.col("further").alias("to")))
    return tree.join(path, "node", "left_semi").select(F.col("depth").alias("step"), "node")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node of each weakly connected component, by minimum labels and pointer jumps."""
    both = undirected(edges)
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("low"))
        new = labels.join(near, "node").select("node", F.least("component", "low").alias("component"))
        jump = new.alias("a").join(new.alias("b"), F.col("a.component") == F.col("b.node")).select("a.node", F.least("a.component", "b.component").alias("component"))
        after = cut(jump)
        if after.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty():
            return after
        labels = after
    raise RuntimeError(f"no end after {rounds} rounds")


def cycles(edges: DataFrame, loops: bool = False) -> DataFrame:
    """(node, cycle): strongly connected components of two nodes or more, named by their smallest, and with loops the nodes that only have an edge to themselves; forward and backward colouring."""
    left = cut(edges.select("src", "dst").where("src <> dst").distinct())
    alone = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("cycle")).distinct()
    found = None
    for k in range(ROUNDS):
        left = _trim(left)
        if left.isEmpty():
            break
        fore = _colour(left, k % 2 == 0)
        inside = left.join(fore.toDF("src", "cs"), "src").join(fore.toDF("dst", "cd"), "dst").where("cs = cd").select("src", "dst", "cs")
        back = fore.where("node = colour").select("node", F.col("node").alias("cycle"))
        level, members = back, cut(back)
        while True:
            step = inside.join(level.toDF("dst", "cycle"), "dst").where("cs = cycle").select(F.col("src").alias("node"), "cycle").distinct()
            level = cut(step.join(members.select("node"), "node", "left_anti"))
            if level.isEmpty():
                break
            members = members.unionByName(level)
        members = cut(members)
        found = members if found is None else found.unionByName(members)
        if k % 16 == 15:
            found = cut(found)
        gone = members.select("node")
        left = cut(left.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti"))
    else:
        raise RuntimeError(f"no end after {ROUNDS} rounds")
    if found is None:
        return alone if loops else alone.limit(0)
    size = F.count("*").over(Window.partitionBy("cycle"))
    out = found.withColumn("n", size).where("n > 1").select("node", F.min("node").over(Window.partitionBy("cycle")).alias("cycle"))
    return out.unionByName(alone.join(out.select("node"), "node", "left_anti")) if loops else out


def _trim(edges: DataFrame) -> DataFrame:
    """Without edges at nodes that have no way in or no way out: they are in no cycle."""
    while True:
        n = edges.count()
        edges = cut(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if edges.count() == n:
            return edges


def _colour(edges: DataFrame, least: bool) -> DataFrame:
    """(node, colour): the smallest or the largest node from which each is reached. Rounds take turns: chains of components whose ids rise or fall come off at once in one of them."""
    pick, of = (F.least, F.min) if least else (F.greatest, F.max)
    now = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("colour", F.col("node")))
    while True:
        step = edges.join(now.toDF("src", "c"), "src").groupBy(F.col("dst").alias("node")).agg(of("c").alias("c"))
        after = cut(now.join(step, "node", "left").select("node", pick("colour", F.coalesce("c", "colour")).alias("colour")))
        if after.join(now.toDF("node", "old"), "node").where("colour <> old").isEmpty():
            return after
        now = after


def random_walk(edges: DataFrame, seed: int, restart: float = 0.15, rounds: int = 10) -> DataFrame:
    """(node, score) after rounds of a walk with restart at seed, from equal scores; mass at nodes without a way out is lost."""
    edges = cut(edges.select("src", "dst").distinct())
    degree = edges.groupBy("src").agg(F.count("*").alias("d"))
    arcs = cut(edges.join(degree, "src"))
    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    n = nodes.count()
    scores = cut(nodes.withColumn("score", F.lit(1.0 / n)))
    for _ in range(rounds):
        flow = arcs.join(scores.toDF("src", "s"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum((1 - restart) * F.col("s") / F.col("d")).alias("f"))
        home = F.when(F.col("node") == seed, restart).otherwise(0.0)
        scores = cut(nodes.join(flow, "node", "left").select("node", (F.coalesce("f", F.lit(0.0)) + home).alias("score")))
    return scores.select("node", F.round("score", 6).alias("score"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label) after synchronous rounds: the most frequent neighbour label, the smallest of equals."""
    both = undirected(edges, loops=False)
    labels = cut(both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
    for _ in range(rounds):
        votes = both.join(labels.toDF("dst", "label"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.count("*").alias("n"))
        labels = cut(votes.groupBy("node").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label")))
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, q): each community's share of the modularity of an undirected graph."""
    both = undirected(edges, loops=False)
    named = both.join(labels.toDF("src", "a"), "src").join(labels.toDF("dst", "b"), "dst")
    total = F.broadcast(both.agg(F.count("*").cast("double").alias("m2")))
    by = named.groupBy(F.col("a").alias("label")).agg(F.count_if(F.col("a") == F.col("b")).alias("inside"), F.count("*").alias("degree"))
    return by.join(total).select("label", (F.round(F.col("inside") / F.col("m2") - F.pow(F.col("degree") / F.col("m2"), 2), 6) + 0.0).alias("q"))


def dependents(edges: DataFrame, node: int, budget: int) -> DataFrame:
    """Direct dependents in order, as many as fit a budget of characters; each takes one or more, so budget of them are looked at."""
    text = F.length(F.col("src").cast("string"))
    total = F.sum(text).over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0))
    return edges.where((F.col("dst") == node) & F.col("src").isNotNull()).select("src").distinct().orderBy("src").limit(budget).withColumn("chars", total).where(F.col("chars") <= budget)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) in one pass over both ends."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
