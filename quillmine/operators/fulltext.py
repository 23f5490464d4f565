"""A kept full-text index: positional postings by term partition, appended segments, tombstones and merging.

Layout below one folder: postings/seg=<n>/part=<p> holds, p being a hash of the term, a row for each term of a block of
documents: their ids and lengths, and all places of the term in them, with the end of each document's. Blocks are made in
the tasks that read the documents, so neither texts nor postings are exchanged;
lengths/seg=<n> holds (id, dl); gone/seg=<n> holds the ids whose rows in segments before n are dead; manifest-<v>.json
names the live segments and the numbers of documents and tokens. A batch of changes is one new segment: what it inserts or
updates is written once, what it updates or deletes is named in gone, and nothing else is read but the lengths that it
kills. The manifest of the next number makes a batch visible, so a batch that dies half-way leaves the index as it was.
After FANOUT segments all are merged into one, without dead rows. A search reads the partitions of its terms alone.

Cases: null and empty texts are documents without tokens; rows without an id are not indexed; of rows of a batch that
share an id the greatest text stays; an id that is deleted and given in one batch is given; deleting an unknown id does
nothing; a query without tokens finds nothing. Tokens are runs of three or more ASCII letters, digits or _, A-Z lowered.
"""

from __future__ import annotations

import json
import string
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import _folder, cut
from .search import B, K1

PARTS, FANOUT = 64, 8
#: Words of the documents of a block, about; a longer document is a block of its own.
BLOCK = 1 << 21
#: Of a number of dead rows up to this one, each task gets the list; beyond, postings are exchanged by id.
DEAD = 8_000_000
STORED = "term string, ids array<long>, dls array<int>, ends array<int>, places array<int>"
TOKEN = "[A-Za-z0-9_]{3,}"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(TOKEN), F.lit(0))


def part_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def _packed(codes: np.ndarray, terms: pa.Array, ids: np.ndarray, dls: np.ndarray, tfs: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """STORED rows of postings sorted by the number of their term, with tfs places each."""
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    ends = np.cumsum(tfs)
    begin = (ends - tfs)[first]
    at = pa.array(np.append(first, len(codes)).astype("int32"))
    spots = pa.array(np.append(begin, len(places)).astype("int32"))
    own = ends - np.repeat(begin, np.diff(np.append(first, len(codes))))
    lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (ids.astype("int64"), dls.astype("int32"), own.astype("int32"))]
    return pa.RecordBatch.from_arrays([terms.take(pa.array(codes[first])).cast(pa.string()), *lists, pa.ListArray.from_arrays(spots, pa.array(places.astype("int32")))], ["term", "ids", "dls", "ends", "places"])


def _blocks_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """STORED rows of documents (id, t), t being their words."""
    for batch in batches:
        ids, lists = batch.column("id").to_numpy(zero_copy_only=False), batch.column("t")
        offsets = lists.offsets.to_numpy().astype("int64")
        offsets -= offsets[0]
        words_, start = lists.flatten(), 0
        while start < len(ids):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BLOCK, "right")) - 1)
            low, high = offsets[start], offsets[stop]
            if high > low:
                coded = words_.slice(low, high - low).dictionary_encode()
                codes, dls = coded.indices.to_numpy(), np.diff(offsets[start : stop + 1])
                order = np.argsort(codes, kind="stable")  # documents and places stay in order
                codes, doc = codes[order], np.repeat(np.arange(start, stop), dls)[order]
                places = (np.arange(high - low) - np.repeat(offsets[start:stop] - low, dls))[order]
                heads = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
                yield _packed(codes[heads], coded.dictionary, ids[doc[heads]], dls[doc[heads] - start], np.diff(np.append(heads, len(codes))), places)
            start = stop


def _blocks_of_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """STORED rows of postings (term, id, dl, positions)."""
    for batch in batches:
        if batch.num_rows:
            coded = batch.column("term").dictionary_encode()
            order = np.argsort(coded.indices.to_numpy(), kind="stable")
            positions = batch.column("positions").take(pa.array(order))
            ids, dls = (batch.column(n).to_numpy(zero_copy_only=False)[order] for n in ("id", "dl"))
            yield _packed(coded.indices.to_numpy()[order], coded.dictionary, ids, dls, positions.value_lengths().to_numpy(zero_copy_only=False), positions.flatten().to_numpy(zero_copy_only=False))


def new_path(spark: SparkSession) -> str:
    return f"{_folder(spark)}/quillmine/fulltext-{uuid.uuid4().hex}"


class FullText:
    """An index in a folder that the cluster shares; opened again, it is as it was left."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- manifest

    def manifest(self) -> dict:
        here = self._hadoop(self.path)
        found = [f.getPath().getName() for f in self._files.listStatus(here)] if self._files.exists(here) else []
        versions = [int(n[9:-5]) for n in found if n.startswith("manifest-") and n.endswith(".json")]
        if not versions:
            return {"version": 0, "segments": [], "next": 1, "docs": 0, "tokens": 0}
        return json.loads(self.spark.read.text(f"{self.path}/manifest-{max(versions)}.json").first()[0])

    def _publish(self, manifest: dict) -> None:
        draft, name = (self._hadoop(f"{self.path}/{n}") for n in (f"draft-{uuid.uuid4().hex}", f"manifest-{manifest['version']}.json"))
        out = self._files.create(draft, False)
        out.writeBytes(json.dumps(manifest))
        out.close()
        if not self._files.rename(draft, name):  # another writer has published this version
            raise RuntimeError(f"manifest {manifest['version']} exists")

    # -- tables

    def _read(self, name: str, schema: str, segments: list[int]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], f"{schema}, seg int")
        paths = [f"{self.path}/{name}/seg={n}" for n in segments]
        return self.spark.read.schema(f"{schema}, seg int").option("basePath", f"{self.path}/{name}").parquet(*paths)

    def _living(self, rows: DataFrame, segments: list[int]) -> DataFrame:
        if len(segments) < 2:
            return rows
        dead = self._read("gone", "id long", segments)
        last = dead.groupBy("id").agg(F.max("seg").alias("last"))
        last = F.broadcast(last) if dead.count() <= DEAD else last
        return rows.join(last, "id", "left").where("last IS NULL OR seg >= last").drop("last")

    def lengths(self) -> DataFrame:
        """(id, dl, seg) of the documents that are in the index."""
        segments = self.manifest()["segments"]
        return self._living(self._read("lengths", "id long, dl int", segments), segments)

    def postings(self, parts: list[int] | None = None) -> DataFrame:
        """(term, id, dl, positions) of the documents that are in the index; of the given term partitions, if any are given."""
        segments = self.manifest()["segments"]
        rows = self._read("postings", f"{STORED}, part int", segments)
        rows = rows.where(F.col("part").isin(parts)) if parts is not None else rows
        begin = lambda i: F.when(i > 0, F.get("ends", i - 1)).otherwise(0)
        places = lambda i: F.slice("places", begin(i) + 1, F.get("ends", i) - begin(i))
        each = F.transform("ids", lambda x, i: F.struct(x.alias("id"), F.get("dls", i).alias("dl"), places(i).alias("positions")))
        rows = rows.select("term", "seg", F.inline(each))
        return self._living(rows, segments).select("term", "id", "dl", "positions")

    # -- changes

    def _write(self, segment: int, blocks: DataFrame, lengths: DataFrame, gone: DataFrame) -> None:
        blocks.withColumn("part", part_of(F.col("term"))).sortWithinPartitions("part", "term").write.partitionBy("part").mode("overwrite").parquet(f"{self.path}/postings/seg={segment}")
        lengths.write.mode("overwrite").parquet(f"{self.path}/lengths/seg={segment}")
        gone.write.mode("overwrite").parquet(f"{self.path}/gone/seg={segment}")

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> None:
        """One batch: upserts (id, text) are inserted or replace what the index has, deletes (id) go."""
        empty = self.spark.createDataFrame([], "id long, text string")
        given = (empty if upserts is None else upserts).select(F.col("id").cast("long").alias("id"), "text").where("id IS NOT NULL")
        twice = cut(given.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
        if not twice.isEmpty():  # only the texts of those are exchanged
            most = given.join(twice, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
            given = given.join(twice, "id", "left_anti").unionByName(most)
        given = given.select("id", words(F.col("text")).alias("t"))
        dead = (empty if deletes is None else deletes).select(F.col("id").cast("long").alias("id")).where("id IS NOT NULL")
        now = self.manifest()
        segment = now["next"]
        ids = given.select("id").unionByName(dead).distinct()
        self._write(segment, given.mapInArrow(_blocks_of_texts, STORED), given.select("id", F.size("t").alias("dl")), ids)
        count = [F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")]
        lost = self.lengths().join(self.spark.read.schema("id long").parquet(f"{self.path}/gone/seg={segment}"), "id", "left_semi").agg(*count).first()
        more = self.spark.read.schema("id long, dl int").parquet(f"{self.path}/lengths/seg={segment}").agg(*count).first()
        now |= {"version": now["version"] + 1, "next": segment + 1, "segments": [*now["segments"], segment]}
        now |= {"docs": now["docs"] - lost["n"] + more["n"], "tokens": now["tokens"] - lost["dl"] + more["dl"]}
        self._publish(now)
        if len(now["segments"]) > FANOUT:
            self.merge()

    def merge(self) -> None:
        """All segments become one, without dead rows."""
        now = self.manifest()
        old, segment = now["segments"], now["next"]
        if len(old) < 2:
            return
        self._write(segment, self.postings().mapInArrow(_blocks_of_postings, STORED), self.lengths().select("id", "dl"), self.spark.createDataFrame([], "id long"))
        self._publish(now | {"version": now["version"] + 1, "next": segment + 1, "segments": [segment]})
        for n in old:
            for name in ("postings", "lengths", "gone"):
                self._files.delete(self._hadoop(f"{self.path}/{name}/seg={n}"), True)

    # -- searches

    def _terms(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(query, place, term) of queries (query, text), and the postings of their terms' partitions."""
        wanted = queries.select("query", F.posexplode(words(F.col("text"))).alias("place", "term"))
        parts = [r["part"] for r in wanted.select(part_of(F.col("term")).alias("part")).distinct().collect()]  # PARTS numbers at most
        return wanted, self.postings(sorted(parts))

    def search(self, queries: DataFrame, limit: int) -> DataFrame:
        """(query, id, score, place, first): the best limit documents by BM25 for every row of queries (query, text), and the first word of each that a query has."""
        wanted, rows = self._terms(queries)
        wanted = wanted.select("query", "term").distinct()
        now = self.manifest()
        n, average = float(now["docs"]), now["tokens"] / now["docs"] if now["docs"] else 1.0
        rows = rows.join(wanted.select("term").distinct(), "term", "left_semi").select("term", "id", "dl", F.size("positions").alias("tf"), F.col("positions")[0].alias("at"))
        df = rows.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.greatest(F.lit(1e-6), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average))
        parts = rows.join(df, "term").select("id", "term", part.alias("part"), "at")
        found = parts.join(wanted, "term").groupBy("query", "id").agg(F.round(F.sum("part"), 6).alias("score"), F.min("at").alias("first"))
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        return found.withColumn("place", place).where(F.col("place") <= limit).select("query", "id", "score", "place", "first")

    def phrase(self, queries: DataFrame) -> DataFrame:
        """(query, id, first, hits): the documents in which the words of a query stand next to each other, where first, and how often."""
        wanted, rows = self._terms(queries)
        words_ = F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"])
        asked = cut(wanted.groupBy("query").agg(F.array_join(words_, " ").alias("phrase"), F.count("*").cast("int").alias("n")))
        lengths = sorted(r["n"] for r in asked.select("n").distinct().collect())  # a few numbers
        # each document's words that queries have, in order: runs of them meet the phrases, so the work is that of the
        # places, however many queries share a frequent word
        rows = rows.join(cut(wanted.select("term").distinct()), "term", "left_semi")
        spots = F.array_sort(F.flatten(F.collect_list(F.transform("positions", lambda x: F.struct(x.alias("at"), F.col("term").alias("term"))))))
        documents = rows.groupBy("id").agg(spots.alias("spots"))  # no longer than the text

        def runs(n: int) -> Column:
            at = lambda i: F.get("spots", i)["at"]
            starts = F.filter(F.sequence(F.lit(0), F.size("spots") - n), lambda i: at(i + n - 1) - at(i) == n - 1)
            found = F.transform(starts, lambda i: F.struct(at(i).alias("start"), F.array_join(F.transform(F.slice("spots", i + 1, n), lambda x: x["term"]), " ").alias("phrase")))
            return F.when(F.size("spots") >= n, found).otherwise(F.array().cast("array<struct<start:int,phrase:string>>"))

        if not lengths:
            return asked.select("query", F.lit(0).cast("long").alias("id"), F.lit(0).alias("first"), F.lit(0).cast("long").alias("hits"))
        each = documents.select("id", F.inline(F.concat(*map(runs, lengths))))
        found = each.join(asked.select("phrase").distinct(), "phrase", "left_semi").groupBy("phrase", "id").agg(F.min("start").alias("first"), F.count("*").alias("hits"))
        return found.join(asked, "phrase").select("query", "id", "first", "hits")


def snippet(text: Column, terms: Column, first: Column, width: int = 40, marks: tuple[str, str] = ("»", "«"), cut: str = "...") -> Column:
    """Up to width words of text from a quarter of width before the word number first, words of terms marked, cut where text goes on."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    gaps = F.split(text, TOKEN, -1)
    n = F.size(found)
    start = F.greatest(F.lit(0), F.least(first - width // 4, n - width))
    end = F.least(n, start + width)
    lowered = lambda w: F.translate(w, string.ascii_uppercase, string.ascii_lowercase)
    marked = lambda w: F.when(F.array_contains(terms, lowered(w)), F.concat(F.lit(marks[0]), w, F.lit(marks[1]))).otherwise(w)
    shown = F.transform(F.slice(found, start + 1, end - start), marked)
    between = F.concat(F.slice(gaps, start + 2, F.greatest(end - start - 1, F.lit(0))), F.array(F.lit("")))
    body = F.array_join(F.zip_with(shown, between, lambda w, g: F.concat(w, g)), "")
    return F.concat(F.when(start > 0, cut).otherwise(""), body, F.when(end < n, cut).otherwise(""))


def with_excerpts(hits: DataFrame, docs: DataFrame, queries: DataFrame, width: int = 40) -> DataFrame:
    """hits (query, id, first, ...) with an excerpt of docs (id, text); only the texts of hits travel."""
    terms = queries.select("query", F.array_distinct(words(F.col("text"))).alias("terms"))
    rows = hits.join(docs.select("id", "text"), "id").join(terms, "query")
    return rows.withColumn("excerpt", snippet(F.col("text"), F.col("terms"), F.col("first"), width)).drop("text", "terms")
