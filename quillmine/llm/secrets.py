"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by its SHA-256. A ledger (Parquet, append only) holds one row for each blob and
rule version that was scanned, with the spans found; only pairs that it lacks are scanned, each blob once, and the
findings are joined back to every path that holds the blob.

Cases: a null text is the empty blob; equal texts are scanned once; an empty table gives an empty result; a null path
is kept as it is. Further columns of the versions are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carrying, checked_broadcast, let, park, scratch


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches of pattern are taken leftmost and non-overlapping; group must have least characters."""

    kind: str
    pattern: str
    group: int
    least: int


#: Kinds in their order, patterns and lengths.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),  # as AKIA[A-Z0-9]+ with 18 characters: what fails holds no match
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # as [0-9a-f]+ with 16 characters: runs are maximal
)

SPAN = "array<struct<start:int,kind:int,stop:int>>"


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    return sha256(repr(rules).encode()).hexdigest()[:16]


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _spans(text: Column, rule: Rule, number: int, found: Column) -> Column:
    """Spans in code points. The pieces between matches and the matches tile the text, so their lengths give the places."""
    total = lambda lengths, n: F.aggregate(F.slice(lengths, F.lit(1), n), F.lit(0), lambda a, x: a + x)
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))

    def placed(z: Column) -> Column:
        right = F.filter(F.sequence(F.lit(1), F.size(z["size"])), lambda i: F.get(z["value"], i - 1) >= rule.least)
        stop = lambda i: total(z["gap"], i) + total(z["size"], i)
        return F.transform(
            right,
            lambda i: F.struct((stop(i) - F.get(z["size"], i - 1)).alias("start"), F.lit(number).alias("kind"), stop(i).alias("stop")),
        )

    parts = F.struct(*[F.transform(x, F.length).alias(n) for x, n in ((F.split(text, rule.pattern, -1), "gap"), (found, "size"), (value, "value"))])
    return let(parts, placed)


def find(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blobs (blob, text) with spans: all matches that count, by start, then kind as listed."""
    out = blobs.withColumns({f"found{i}": F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)) for i, r in enumerate(rules)})
    none = F.array().cast(SPAN)
    parts = [F.when(F.size(f"found{i}") > 0, _spans(F.col("text"), r, i, F.col(f"found{i}"))).otherwise(none) for i, r in enumerate(rules)]
    return out.select("blob", F.array_sort(F.concat(*parts)).cast(SPAN).alias("spans"))


class BlobLedger:
    """The ledger at path: rows (blob, rule_version, spans)."""

    SCHEMA = f"blob string, rule_version string, spans {SPAN}"

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules, self.version = spark, path, rules, rule_version(rules)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            spark.createDataFrame([], self.SCHEMA).write.parquet(path)

    def rows(self) -> DataFrame:
        """What was found under these rules, one row for each blob: scans that ran at the same time may have written one twice."""
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("rule_version") == self.version)
        return rows.select("blob", "spans").dropDuplicates(["blob"])

    def scan(self, versions: DataFrame) -> DataFrame:
        """Scan the blobs of versions (path, text) that the ledger lacks; returns (path, blob, spans) for all versions."""
        paths = park(versions.select("path", blob_id(F.col("text")).alias("blob")), "paths")
        unseen = paths.groupBy("blob").agg(F.min("path").alias("holder"))
        unseen = park(unseen.join(self.rows(), "blob", "left_anti"), "unseen")
        held = unseen.where(F.col("holder").isNotNull()).select(F.col("holder").alias("path"), F.col("blob").alias("want"))
        texts = versions.select("path", F.coalesce("text", F.lit("")).alias("text"))
        one = texts.join(held, "path").withColumn("blob", blob_id(F.col("text"))).where("blob = want")
        # a path may have several versions, and rows may repeat
        self._append(find(one.select("blob", "text"), self.rules).dropDuplicates(["blob"]))
        stray = unseen.where(F.col("holder").isNull()).select("blob")
        if not stray.isEmpty():
            lost = versions.where(F.col("path").isNull()).select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
            self._append(find(lost.join(stray, "blob", "left_semi").dropDuplicates(["blob"]), self.rules))
        known = park(self.rows().join(paths.select("blob"), "blob", "left_semi"), "known")  # a plain scan, so that AQE can split a hot blob's paths
        return paths.join(known, "blob").select("path", "blob", "spans")

    def _append(self, found: DataFrame) -> None:
        found.select("blob", F.lit(self.version).alias("rule_version"), "spans").write.mode("append").parquet(self.path)


def scan_secrets(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, spans) for versions (path, text); a ledger path keeps what was scanned for later calls."""
    spark = versions.sparkSession
    return BlobLedger(spark, ledger or scratch(spark, "ledger"), rules).scan(versions)


def joined_spans(spans: Column, kinds: tuple[str, ...] = tuple(r.kind for r in RULES)) -> Column:
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in kinds]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_of(spans: Column, number: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with mark in place of every span; overlapping spans give one mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out"),
        F.greatest(a["at"], s["stop"]).alias("at"),
    )
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


@carrying("doc_id", "text", "n_chars")
def mask(docs: DataFrame, ledger: str | None = None, mark: str = "[secret]") -> DataFrame:
    """docs with every secret in text masked, and n_chars (if there) of the new text; findings come back by blob, so rows without an id count too."""
    spark = docs.sparkSession
    book = BlobLedger(spark, ledger or scratch(spark, "ledger"))
    book.scan(docs.select(F.col("doc_id").alias("path"), "text"))
    found = park(book.rows().where(F.size("spans") > 0).dropDuplicates(["blob"]).toDF("__blob", "__spans"), "found")
    out = docs.join(checked_broadcast(found), blob_id(docs["text"]) == F.col("__blob"), "left")
    held = F.col("__spans").isNotNull()
    new = F.when(held, redact(docs["text"], F.col("__spans"), mark)).otherwise(docs["text"])
    columns = {"text": new, "n_chars": F.when(held, F.length(new).cast("long")).otherwise(docs["n_chars"])} if "n_chars" in docs.columns else {"text": new}
    return out.select([columns.get(c, docs[c]).alias(c) for c in docs.columns])
