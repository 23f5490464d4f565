"""Distillation by description length: clusters of like titles become an abstraction and one delta a member, where that is shorter.

Rows of one kind are clustered by single link (Jaccard of token sets, title_clusters). A cluster's abstraction is its
kind and the pieces (between single blanks) that at least SHARED of its members hold, the most frequent MOST of them. A
member's delta is its title with each such piece replaced by @ and its number in the abstraction; pieces that begin with
@ or \\ get a \\ in front, so a delta and its abstraction give back the title exactly (restored()). Lengths are summed in
whole characters, a quarter of a token each, before and after; what saves less than LEAST of the length stays as it is.
All sums are mergeable aggregates by cluster, and pieces and members meet by (cluster, piece), so no cluster is gathered.

Cases: null and empty titles are in no cluster; equal titles are members of their own; rows of an id that is null are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import space_tokens
from .graph import cut
from .store import title_clusters

SHARED, MOST, LEAST = 0.7, 20, 0.2
JACCARD, MEMBERS = 0.4, 3


def clusters(rows: DataFrame, threshold: float = JACCARD, least: int = MEMBERS) -> DataFrame:
    """(id, cluster) of rows (id, kind, title), within kinds."""
    marked = F.transform(space_tokens(F.col("title")), lambda t: F.concat(F.coalesce("kind", F.lit("note")), F.lit("\x1f"), t))
    return title_clusters(rows.where("id IS NOT NULL").select("id", F.array_join(marked, " ").alias("title")), threshold, least)


def restored(delta: Column, pieces: Column) -> Column:
    """The title of a delta and the pieces of its abstraction."""
    back = lambda p: (
        F.when(p.startswith("@"), F.get(pieces, F.substr(p, F.lit(2)).cast("int"))).when(p.startswith("\\"), F.substr(p, F.lit(2))).otherwise(p)
    )
    return F.array_join(F.transform(F.split(delta, " ", -1), back), " ")


def distilled(rows: DataFrame, found: DataFrame, shared: float = SHARED, most: int = MOST) -> DataFrame:
    """(id, cluster, title, delta, pieces, abstraction, members, before, after) of the members of found (id, cluster)."""
    held = cut(found.join(rows.where("id IS NOT NULL AND title IS NOT NULL"), "id").select("cluster", "id", "kind", "title"))
    size = held.groupBy("cluster").agg(F.count("*").alias("members"), F.sum(F.length("title")).alias("before"), F.min(F.coalesce("kind", F.lit("note"))).alias("kind"))
    spots = held.select("cluster", "id", F.posexplode(F.split("title", " ", -1)).alias("at", "piece"))
    counts = spots.where("length(piece) > 2").groupBy("cluster", "piece").agg(F.countDistinct("id").alias("n"))
    number = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "piece")) - 1
    # a cluster's pieces held by so many members are at most 80 / shared, as titles are short
    common = counts.join(size, "cluster").where(F.col("n") >= F.col("members") * shared).withColumn("number", number).where(F.col("number") < most)
    common = cut(common.select("cluster", "piece", "number"))
    heads = common.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "piece"))), lambda x: x["piece"]).alias("pieces"))
    coded = F.when(F.col("number").isNotNull(), F.concat(F.lit("@"), F.col("number").cast("string"))).when(F.col("piece").rlike(r"^[@\\]"), F.concat(F.lit("\\"), "piece")).otherwise(F.col("piece"))
    deltas = spots.join(common, ["cluster", "piece"], "left").groupBy("cluster", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", coded.alias("code")))), lambda x: x["code"]), " ").alias("delta"))
    text = F.concat(F.lit("[MDL:"), "kind", F.lit("] "), F.array_join(F.coalesce("pieces", F.array().cast("array<string>")), " "))
    whole = size.join(heads, "cluster", "left").select("cluster", "members", "before", F.coalesce("pieces", F.array().cast("array<string>")).alias("pieces"), text.alias("abstraction"))
    after = deltas.groupBy("cluster").agg(F.sum(F.length("delta")).alias("deltas"))
    whole = whole.join(after, "cluster").withColumn("after", F.col("deltas") + F.length("abstraction")).drop("deltas")
    return held.join(deltas, ["cluster", "id"]).join(whole, "cluster").select("id", "cluster", "title", "delta", "pieces", "abstraction", "members", "before", "after")


def accepted(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """distilled() rows whose cluster is shortened by least or more, with compression."""
    saved = (F.col("before") - F.col("after")) / F.col("before")
    return rows.where(F.col("before") > 0).withColumn("compression", F.round(saved, 4)).where(saved >= least)


def applied(rows: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (id, kind, title) with members rewritten and abstractions added (negative ids: -1 - cluster), and links (source, target, link_type) from these to their members."""
    mine = chosen.select("id", F.concat(F.lit("[delta] "), "delta").alias("delta"))
    kept = rows.join(mine, "id", "left").select("id", "kind", F.coalesce("delta", "title").alias("title"))
    source = (-1 - F.col("cluster")).alias("source")
    heads = chosen.select(source, "abstraction").distinct().select(F.col("source").alias("id"), F.lit("convention").alias("kind"), F.col("abstraction").alias("title"))
    return kept.unionByName(heads), chosen.select(source, F.col("id").alias("target"), F.lit("supersedes").alias("link_type"))
