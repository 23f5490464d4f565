"""Snapshots of a table as hash trees over key ranges, and what has changed between two of them.

A snapshot is rows/<name>/part=<p> with (key, leaf, row, hash), leaf being a range of WIDTH keys and part a range of FAN
leaves, and digests/<name> with a digest of every leaf, every part and the whole. A digest is the number of rows and two
sums over their hashes, so it is a mergeable aggregate and the order of rows does not matter. compare() looks at the
whole, then at parts, then at leaves, and reads rows of the leaves that differ alone (partitions and, by their sorted
files' statistics, row groups); what lies in equal ranges is not read.

Cases: rows without a key are not kept; of rows that share a key one (the greatest hash) is; columns are compared by name
and as values (null equals null), a column that one side lacks makes its rows differ; an empty snapshot is one like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, FAN = 256, 64
#: Differing ranges that are named in a filter at most; beyond that all are read, and the join does the rest.
NAMED = 2000


def digest(hash_: Column) -> list[Column]:
    half = lambda start: F.sum(F.conv(F.substring(hash_, start, 14), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    return [F.count("*").alias("n"), half(1).alias("first"), half(15).alias("second")]


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, name: str, rows: DataFrame, key: str) -> None:
        """Keep rows, by the whole number in their column key, under a new name."""
        body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
        kept = rows.select(F.col(f"`{key}`").cast("long").alias("key"), body.alias("row")).where("key IS NOT NULL").withColumn("hash", F.md5("row"))
        kept = kept.groupBy("key").agg(F.max(F.struct("hash", "row")).alias("one")).select("key", "one.*")
        leaf = F.floor(F.col("key") / WIDTH).cast("long")
        kept = kept.withColumn("leaf", leaf).withColumn("part", F.floor(F.col("leaf") / FAN).cast("long"))
        kept.repartition("part").sortWithinPartitions("part", "key").write.partitionBy("part").parquet(f"{self.path}/rows/{name}")
        leaves = self.rows(name).groupBy("part", "leaf").agg(*digest(F.col("hash")))
        leaves.write.parquet(f"{self.path}/digests/{name}")

    def rows(self, name: str) -> DataFrame:
        return self.spark.read.schema("key long, hash string, row string, leaf long, part long").parquet(f"{self.path}/rows/{name}")

    def _digests(self, name: str, *level: str) -> DataFrame:
        leaves = self.spark.read.schema("part long, leaf long, n long, first decimal(38,0), second decimal(38,0)").parquet(f"{self.path}/digests/{name}")
        return leaves.groupBy(*level).agg(*[F.sum(c).alias(c) for c in ("n", "first", "second")])

    def _differing(self, a: str, b: str, level: str, within: list[int] | None = None) -> list[int] | None:
        """The ranges of a level whose digests differ; None if they are more than NAMED."""
        one, two = (self._digests(x, *dict.fromkeys(("part", level))) for x in (a, b))
        if within is not None:
            one, two = one.where(F.col("part").isin(within)), two.where(F.col("part").isin(within))
        keys = list(dict.fromkeys(("part", level)))
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("n", "first", "second")]
        both = one.alias("a").join(two.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full")
        found = both.where(~(same[0] & same[1] & same[2])).select(F.coalesce(f"a.{level}", f"b.{level}").alias("x")).limit(NAMED + 1).collect()
        return [r["x"] for r in found] if len(found) <= NAMED else None

    def equal(self, a: str, b: str) -> bool:
        return self._digests(a).first() == self._digests(b).first()

    def changed_rows(self, name: str, parts: list[int] | None, leaves: list[int] | None) -> DataFrame:
        rows = self.rows(name)
        rows = rows if parts is None else rows.where(F.col("part").isin(parts))
        return rows if leaves is None else rows.where(F.col("leaf").isin(leaves))

    def compare(self, a: str, b: str) -> DataFrame:
        """(key, change, before, after): the keys that were added, removed or changed from a to b, with their rows as JSON."""
        parts = [] if self.equal(a, b) else self._differing(a, b, "part")
        leaves = [] if parts == [] else self._differing(a, b, "leaf", parts)
        old, new = (self.changed_rows(x, parts, leaves) for x in (a, b))
        both = old.select("key", F.col("row").alias("before"), F.col("hash").alias("had")).join(new.select("key", F.col("row").alias("after"), "hash"), "key", "full")
        change = F.when(F.col("had").isNull(), "added").when(F.col("hash").isNull(), "removed").when(F.col("had") != F.col("hash"), "changed")
        return both.select("key", change.alias("change"), "before", "after").where("change IS NOT NULL")
