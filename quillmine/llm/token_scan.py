"""Token counts by separator scan over flat, unindexed token files.

Writing: each task encodes its texts by byte-level BPE and appends the ids to one file of fixed-width integers, an
end-of-document id after each text. Nothing in the files says where documents are; which document is the n-th of a
file is kept in a table. Scanning: files are cut into blocks of equal size wherever that falls. A task searches a
block for the separator with one vectorised comparison and reports the pieces between separators; an exclusive
prefix sum of the blocks' separator counts numbers the pieces in the file, and pieces of one number, which blocks
cut apart, are added up.

Cases: null and empty texts have 0 tokens; the separator's own spelling in a text is ordinary text; a text may span
any number of blocks; repeated rows are counted each; an empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_folder, park, shared_file, task_count

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how a byte-level vocabulary cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Ids in a block.
BLOCK = 1 << 20


#: White space so long that the pattern's matcher would run out of stack on it.
_LONG = re.compile(r"[^\S\x1c-\x1f]{%d,}" % (1 << 15))


def cut(text: str) -> Iterator[str]:
    """text in parts that give the pieces of the whole: white space before a word is one piece but for its last character, which goes with what follows. At the end of a text it is one piece as it is."""
    at = 0
    for found in _LONG.finditer(text):
        if found.end() < len(text):
            yield text[at : found.start()]
            yield text[found.start() : found.end() - 1]
            at = found.end() - 1
    yield text[at:]


def ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file's tokens (base64) and ids; read by the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def write_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> tuple[DataFrame, DataFrame, int]:
    """Token files of docs: (files: file, ids; order: file, ordinal, doc_id; the separator's id). Both are written.

    A task that is run again writes a file of its own, and only the files of tasks that ended well are in the tables.
    """
    spark = docs.sparkSession
    table = ranks(vocabulary)
    separator = max(table.values()) + 1
    width = np.dtype("<u2") if separator < 1 << 16 else np.dtype("<u4")
    folder = new_folder(spark, "tokens")
    shipped = spark.sparkContext.broadcast(table)  # one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=shipped.value, special_tokens={})
        file = f"{folder}/{uuid.uuid4().hex}.bin"
        system, path = shared_file(file)
        end, written, ordinal = np.array([separator], width), 0, 0
        out = None
        for batch in batches:
            out = out or system.open_output_stream(path, compression=None)
            for text in batch.column("text"):
                ids = np.concatenate([encoding.encode_to_numpy(part, disallowed_special=()) for part in cut(text.as_py() or "")]).astype(width)
                out.write(ids.tobytes() + end.tobytes())
                written += len(ids) + 1
            n = batch.num_rows
            yield pa.record_batch([pa.array([file] * n), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column("doc_id"), pa.nulls(n, pa.int64())], ["file", "ordinal", "doc_id", "ids"])
            ordinal += n
        if out:
            out.close()
            empty = pa.nulls(1, batch.schema.field("doc_id").type)
            yield pa.record_batch([pa.array([file]), pa.nulls(1, pa.int64()), empty, pa.array([written], pa.int64())], ["file", "ordinal", "doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = park(docs.select("doc_id", "text").mapInArrow(run, f"file string, ordinal long, doc_id {kind}, ids long"), "order")
    return rows.where("ids IS NOT NULL").select("file", "ids"), rows.where("ids IS NULL").select("file", "ordinal", "doc_id"), separator


def scan(files: DataFrame, separator: int, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, tokens) of every document of files (file, ids); what follows the last separator counts as one more."""
    width = np.dtype("<u2") if separator < 1 << 16 else np.dtype("<u4")
    todo = files.select("file", F.explode(F.sequence(F.lit(0), F.expr(f"greatest(ids - 1, 0) div {block}"))).alias("block"))
    per_file = F.expr(f"greatest(ids - 1, 0) div {block} + 1")
    total = files.agg(F.coalesce(F.sum("ids"), F.lit(0)).alias("ids"), F.coalesce(F.sum(per_file), F.lit(0)).alias("blocks")).first()
    todo = todo.repartition(task_count(files.sparkSession, total["ids"] * width.itemsize, total["blocks"]), "file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, number in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
                system, path = shared_file(file)
                with system.open_input_file(path) as source:
                    size = max(0, min(block * width.itemsize, source.size() - number * block * width.itemsize))
                    ids = np.frombuffer(source.read_at(size, number * block * width.itemsize), width)
                ends = np.flatnonzero(ids == separator)
                edges = np.concatenate([[-1], ends, [len(ids)]])
                n = len(edges) - 1
                columns = [pa.array([file] * n), pa.array(np.full(n, number, np.int64)), pa.array(np.arange(n)), pa.array(np.full(n, n - 1, np.int64)), pa.array(np.diff(edges) - 1)]
                yield pa.record_batch(columns, ["file", "block", "piece", "ends", "tokens"])

    pieces = park(todo.mapInArrow(run, "file string, block long, piece long, ends long, tokens long"), "pieces")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = pieces.where("piece = 0").select("file", "block", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("first"))
    numbered = pieces.join(first, ["file", "block"]).select("file", (F.col("first") + F.col("piece")).alias("ordinal"), "tokens")
    return numbered.groupBy("file", "ordinal").agg(F.sum("tokens").alias("tokens"))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens) of every row of docs."""
    files, order, separator = write_tokens(docs, vocabulary)
    return order.join(scan(files, separator, block), ["file", "ordinal"]).select("doc_id", F.col("tokens").alias("n_tokens"))
