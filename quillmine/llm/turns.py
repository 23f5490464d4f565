"""Conversation structure repair: the cheapest edits that make a conversation a system turn, if any, and pairs of user and assistant.

A turn is a 4x4 matrix over the states start, after system, after user, after assistant: its cell (i, j) is the cheapest
edit of that turn that leads from i to j, as (cost, audit), where audit names the edits by their initials (Keep, Rerole,
Delete, Insert). Matrices multiply by (min, +) with audits joined and ties going to the ASCII-least audit; insertions
enter as a closure (start and assistant lead to user, user to assistant, at the price of an insertion) after each turn.
Of two audits for the same turns that cost the same, neither begins the other (what it would have more are insertions,
which cost), so the order is kept when the same edits follow, and the product is associative.

Turns are dealt by ranges of (conversation, turn), so a long conversation spans tasks. Each task multiplies the stretches
of its range, CHUNK rows at most, into nodes. Nodes of one conversation are multiplied FAN at a time, level by level,
until one is left; its cell from start to start or assistant is the answer. Back down the levels each node learns the
states it begins and ends in, so it can expand its own edits. All of this sees hashes, initials and faults; texts
are joined to the turns that stay, and inserted turns have none.

Faults, the first of a row counts: blank (no visible character), duplicate (the role and text of an earlier row of the
conversation), truncated (the last visible character is none of . ! ?).

Cases: null roles and texts read as one space; null conv_ids are one conversation of their own; null turns come first;
rows of one turn are in the order of role, then MD5 of the text; equal rows are adjacent, all but the first of them
duplicates; an empty table gives an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import park

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: Rows of one node of a conversation, and nodes that one step of the tree multiplies.
CHUNK, FAN = 512, 16
#: Parts into which the repeats of one text in one conversation are dealt.
SALTS = 16
#: Bytes of repaired text in one piece of a conversation that spans tasks.
PIECE = 1 << 20
BLANK = r"[\x20\x09-\x0D]"
_KEY = ("c", "timed", "turn", "role", "h")

Cell = tuple[int, str] | None
Vector = list[Cell]


def _least(*cells: Cell) -> Cell:
    return min((x for x in cells if x is not None), default=None)


def _then(cell: Cell, cost: int, edits: str) -> Cell:
    return None if cell is None else (cell[0] + cost, cell[1] + edits)


def closed(v: Vector) -> Vector:
    """v, with insertions after it."""
    user = _least(v[2], _then(v[0], INSERT, "I"), _then(v[1], INSERT, "I"), _then(v[3], INSERT, "I"))
    return [v[0], v[1], user, _least(v[3], _then(user, INSERT, "I"))]


def after_turn(v: Vector, initial: str, fault: str, copies: int) -> Vector:
    """A vector of cells after a turn (initial of its role, first fault or "") and copies - 1 duplicates of it."""
    new = [_then(x, DELETE, "D") for x in v]
    if fault not in ("blank", "duplicate"):
        more = CUT if fault == "truncated" else 0
        if initial == "s":
            new[1] = _least(new[1], _then(v[0], KEEP + more, "K"))
        for state, own, before in ((2, "u", (0, 1, 3)), (3, "a", (2,))):
            price, letter = (KEEP, "K") if initial == own else (REROLE, "R")
            new[state] = _least(new[state], *[_then(v[b], price + more, letter) for b in before])
    new = closed(new)
    return closed([_then(x, DELETE * (copies - 1), "D" * (copies - 1)) for x in new]) if copies > 1 else new


def begin(state: int) -> Vector:
    return closed([(0, "") if k == state else None for k in range(4)])


def product(a: dict, b: dict) -> dict:
    """The (min, +) product of {(i, j): (cost, audit, states at the ends of its parts)}."""
    out = {}
    for (i, k), (cost, audit, path) in a.items():
        for j in range(4):
            if (k, j) in b:
                more, edits, tail = b[k, j]
                x = (cost + more, audit + edits, path + tail)
                if (i, j) not in out or x[:2] < out[i, j][:2]:
                    out[i, j] = x
    return out


def prepared(turns: DataFrame) -> DataFrame:
    """c (the conversation, as text that is never null), timed and turn, role, h (MD5 of the text), text."""
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    return turns.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("c"),
        F.col("turn").isNotNull().cast("int").alias("timed"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        role.alias("role"), F.md5(text).alias("h"), text.alias("text"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """_KEY, n copies and the first copy's fault, for every distinct row of prepared()."""
    blank = F.regexp_replace("text", BLANK, "") == ""
    cut = ~F.col("text").rlike(rf"[.!?]{BLANK}*\z")
    light = park(rows.groupBy(*_KEY, blank.alias("blank"), cut.alias("cut")).agg(F.count("*").alias("n")), "turns")
    # what recurs under another turn; a text that one conversation repeats without end is dealt over SALTS parts
    again = light.groupBy("c", "role", "h").agg(F.min(F.struct("timed", "turn")).alias("origin"), F.count("*").alias("m")).where("m > 1")
    again = again.select("c", "role", "h", "origin", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    marked = light.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int")).join(again, ["c", "role", "h", "salt"], "left")
    later = F.coalesce(F.struct("timed", "turn") > F.col("origin"), F.lit(False))
    fault = F.when(F.col("blank"), "blank").when(later, "duplicate").when(F.col("cut"), "truncated").otherwise("")
    return marked.select(*_KEY, "n", fault.alias("fault"))


_ROW = pa.struct([("timed", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("h", pa.string()), ("n", pa.int64())])
_CELL = pa.struct([("i", pa.int32()), ("j", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("path", pa.list_(pa.int32()))])
_NODE = pa.schema([("c", pa.string()), ("at", pa.struct(list(_ROW)[:4])), ("rows", pa.list_(_ROW)), ("cells", pa.list_(_CELL)), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string())])
_CELLS = "array<struct<i:int,j:int,cost:bigint,audit:string,path:array<int>>>"
_AT = "struct<timed:int,turn:bigint,role:string,h:string>"
_NODE_SQL = f"c string, at {_AT}, rows array<struct<timed:int,turn:bigint,role:string,h:string,n:bigint>>, cells {_CELLS}, illegal bigint, head string, tail string"


class Node:
    """A stretch of turns of one conversation; from start only if the conversation is known to begin here."""

    def __init__(self, c: str, whole: bool):
        self.c, self.rows, self.illegal = c, [], 0
        self.vectors = {i: begin(i) for i in ((0,) if whole else range(4))}

    def add(self, row: dict, fault: str) -> None:
        initial = row["role"][:1]
        last = self.rows[-1]["role"][:1] if self.rows else None
        self.illegal += row["n"] - 1 + (last is not None and last + initial not in ("su", "ua", "au"))
        self.rows.append(row)
        for i, v in self.vectors.items():
            self.vectors[i] = after_turn(v, initial, fault, row["n"])

    def record(self) -> dict:
        cells = [{"i": i, "j": j, "cost": x[0], "audit": x[1], "path": [j]} for i, v in self.vectors.items() for j, x in enumerate(v) if x is not None]
        at = {k: self.rows[0][k] for k in ("timed", "turn", "role", "h")}
        return {"c": self.c, "at": at, "rows": self.rows, "cells": cells, "illegal": self.illegal, "head": self.rows[0]["role"][:1], "tail": self.rows[-1]["role"][:1]}


def nodes(light: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The nodes of all conversations: c, at (its first row's place), rows, cells, illegal, head, tail."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ready = None, []
        for batch in batches:
            for row in batch.to_pylist():
                c, fault = row.pop("c"), row.pop("fault")
                if node is None or node.c != c or len(node.rows) >= chunk:
                    whole = node is not None and node.c != c  # the range's first stretch may go on from another task's
                    if node is not None:
                        ready.append(node.record())
                    node = Node(c, whole)
                node.add(row, fault)
                if len(ready) >= 256:
                    yield pa.RecordBatch.from_pylist(ready, schema=_NODE)
                    ready = []
        if node is not None:
            ready.append(node.record())
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=_NODE)

    return light.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY).select(*_KEY, "n", "fault").mapInArrow(walk, _NODE_SQL)


def _multiply(fan: int):
    def run(table: pa.Table) -> pa.Table:
        """Nodes c, place, cells of one group, in one."""
        parts = sorted(table.to_pylist(), key=lambda r: r["place"])
        whole = None
        for part in parts:
            cells = {(x["i"], x["j"]): (x["cost"], x["audit"], (x["j"],)) for x in part["cells"]}
            whole = cells if whole is None else product(whole, cells)
        cells = [{"i": i, "j": j, "cost": x[0], "audit": x[1], "path": list(x[2])} for (i, j), x in sorted(whole.items())]
        row = {"c": parts[0]["c"], "place": (parts[0]["place"] - 1) // fan + 1, "cells": cells}
        return pa.Table.from_pylist([row], schema=pa.schema([("c", pa.string()), ("place", pa.int64()), ("cells", pa.list_(_CELL))]))

    return run


def _answer(cells: Column) -> Column:
    """The cheapest cell from start to an end: after nothing, or after an assistant."""
    ends = F.filter(cells, lambda x: (x["i"] == 0) & x["j"].isin(0, 3))
    return F.array_min(F.transform(ends, lambda x: F.struct(x["cost"].alias("cost"), x["audit"].alias("audit"), x["j"].alias("j"))))


@dataclass
class Repair:
    """audits: c, cost, audit, illegal; edits: c, place, k (order), role, and the turn that stays (null for an insertion)."""

    audits: DataFrame
    edits: DataFrame


def solve(light: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> Repair:
    """The repair of all conversations of faults()."""
    made = park(nodes(light, chunk), "turn-nodes")
    w = Window.partitionBy("c").orderBy("at")
    pair = F.concat(F.lag("tail").over(w), F.col("head"))
    seam = F.coalesce((~pair.isin("su", "ua", "au")).cast("long"), F.lit(0))
    numbers = made.select("c", "at", F.row_number().over(w).cast("long").alias("place"), (F.col("illegal") + seam).alias("illegal"))
    numbers = park(numbers.withColumn("total", F.count("*").over(Window.partitionBy("c"))), "turn-numbers")
    counted = numbers.groupBy("c").agg(F.sum("illegal").alias("illegal"))
    placed = park(made.join(numbers.select("c", "at", "place", "total"), ["c", "at"]), "turn-placed")
    alone = placed.where("total = 1").withColumn("answer", _answer(F.col("cells")))
    answers = alone.select("c", "answer.cost", "answer.audit")
    picked = alone.select("c", "place", "rows", F.lit(0).alias("i"), F.col("answer.audit").alias("audit"))

    most = numbers.agg(F.max("total")).first()[0] or 0
    if most > 1:
        levels = [placed.where("total > 1").select("c", "place", "cells")]
        while most > 1:
            up = levels[-1].groupBy("c", F.expr(f"(place - 1) div {fan}").alias("g")).applyInArrow(_multiply(fan), f"c string, place bigint, cells {_CELLS}")
            levels.append(park(up, "turn-level"))
            most = -(-most // fan)
        top = levels[-1].withColumn("answer", _answer(F.col("cells")))
        answers = answers.unionByName(top.select("c", "answer.cost", "answer.audit"))
        states = top.select("c", "place", F.lit(0).alias("i"), F.col("answer.j").alias("j"))
        for level in reversed(levels[1:]):
            chosen = level.join(states, ["c", "place"]).select("c", "place", "i", F.filter("cells", lambda x: (x["i"] == F.col("i")) & (x["j"] == F.col("j")))[0]["path"].alias("path"))
            child = chosen.select("c", "place", F.col("i").alias("first"), "path", F.posexplode("path").alias("m", "j"))
            states = child.select("c", ((F.col("place") - 1) * fan + F.col("m") + 1).alias("place"), F.when(F.col("m") == 0, F.col("first")).otherwise(F.get("path", F.col("m") - 1)).alias("i"), "j")
            states = park(states, "turn-states")
        own = placed.where("total > 1").join(states, ["c", "place"])
        edit = F.filter("cells", lambda x: (x["i"] == F.col("i")) & (x["j"] == F.col("j")))[0]["audit"]
        picked = picked.unionByName(own.select("c", "place", "rows", "i", edit.alias("audit")))
    return Repair(answers.join(counted, "c"), picked.mapInArrow(_expand, "c string, place bigint, k bigint, new_role string, timed int, turn bigint, role string, h string"))


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns that the edits of each node leave, in order."""
    schema = pa.schema([("c", pa.string()), ("place", pa.int64()), ("k", pa.int64()), ("new_role", pa.string()), *list(_ROW)[:4]])
    for batch in batches:
        out = []
        for node in batch.to_pylist():
            state, rows, left, row, k = node["i"], iter(node["rows"]), 0, None, 0
            for letter in node["audit"]:
                if letter != "I":
                    if not left:
                        row = next(rows)
                        left = row["n"]
                    left -= 1
                if letter == "D":
                    continue
                state = 1 if letter == "K" and row["role"][:1] == "s" else 3 if state == 2 else 2
                role = row["role"] if letter == "K" else {2: "user", 3: "assistant"}[state]
                kept = row if letter != "I" else {}
                out.append({"c": node["c"], "place": node["place"], "k": k, "new_role": role, **{x: kept.get(x) for x in ("timed", "turn", "role", "h")}})
                k += 1
        for k in range(0, len(out), 4096) if out else ():
            yield pa.RecordBatch.from_pylist(out[k : k + 4096], schema=schema)


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(c, place, k, role, text) of the turns after repair, in order of place and k."""
    keys = list(_KEY)
    stay = edits.where("h IS NOT NULL").join(rows.dropDuplicates(keys).select(*keys, "text"), keys)
    new = edits.where("h IS NULL").withColumn("text", F.lit(""))
    return stay.select("c", "place", "k", "new_role", "text").unionByName(new.select("c", "place", "k", "new_role", "text")).withColumnRenamed("new_role", "role")


def digests(lines: DataFrame) -> DataFrame:
    """(c, sha256) of each conversation's role:text lines, joined by a line feed.

    Lines are dealt by ranges and each task hashes the conversations that lie within its range. The first and the last of
    a range may go on in others; they come out as pieces of about PIECE bytes, which one task a conversation streams
    through a hash in order, holding one at a time (a hash cannot be had in parts)."""

    def walk(batches):
        schema = pa.schema([("c", pa.string()), ("place", pa.int64()), ("k", pa.int64()), ("piece", pa.binary()), ("sha256", pa.string())])
        current, at, held, size, first = None, None, [], 0, True

        def piece():
            return {"c": current, "place": at[0], "k": at[1], "piece": b"\n".join(held), "sha256": None}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["c"] != current:
                    if current is not None:
                        out.append(piece() if first else {"c": current, "place": None, "k": None, "piece": None, "sha256": hashlib.sha256(b"\n".join(held)).hexdigest()})
                        first = False
                    current, held, size = row["c"], [], 0
                elif size >= PIECE:
                    out.append(piece())
                    held, size, first = [], 0, True  # it has a piece out, so the rest are pieces too
                if not held:
                    at = (row["place"], row["k"])
                held.append(f"{row['role']}:{row['text']}".encode())
                size += len(held[-1])
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if current is not None:
            yield pa.RecordBatch.from_pylist([piece()], schema=schema)

    ranged = lines.repartitionByRange("c", "place", "k").sortWithinPartitions("c", "place", "k")
    made = park(ranged.mapInArrow(walk, "c string, place bigint, k bigint, piece binary, sha256 string"), "turn-pieces")

    def chain(batches):
        current, state = None, None
        for batch in batches:
            out = []
            for c, piece in zip(batch.column("c").to_pylist(), batch.column("piece")):
                if c != current:
                    if current is not None:
                        out.append((current, state.hexdigest()))
                    current, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(piece.as_py())
            yield pa.RecordBatch.from_pydict({"c": [x[0] for x in out], "sha256": [x[1] for x in out]}, pa.schema([("c", pa.string()), ("sha256", pa.string())]))
        if current is not None:
            yield pa.RecordBatch.from_pydict({"c": [current], "sha256": [state.hexdigest()]})

    split = made.where("piece IS NOT NULL").select("c", "place", "k", "piece").repartition("c").sortWithinPartitions("c", "place", "k")
    return made.where("sha256 IS NOT NULL").select("c", "sha256").unionByName(split.select("c", "piece").mapInArrow(chain, "c string, sha256 string"))


def counts(light: DataFrame) -> DataFrame:
    """(c, gaps, blank, duplicate, truncated) of faults()."""
    n, fault = F.col("n"), F.col("fault")
    by_turn = light.groupBy("c", "timed", "turn").agg(
        F.sum(F.when(fault == "blank", n).otherwise(0)).alias("blank"),
        F.sum(F.when(fault == "duplicate", n).when(fault == "blank", 0).otherwise(n - 1)).alias("duplicate"),
        F.sum(F.when(fault == "truncated", 1).otherwise(0)).alias("truncated"),
    )
    timed = F.when(F.col("timed") == 1, F.col("turn"))
    gaps = F.coalesce(F.max(timed) - F.min(timed) + 1 - F.count(timed), F.lit(0))
    return by_turn.groupBy("c").agg(gaps.alias("gaps"), *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")])


def repair(turns: DataFrame, everyone: DataFrame | None = None, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Per conversation of everyone (conv_id; by default those of turns): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = prepared(turns)
    light = park(faults(rows), "turn-faults")
    found = solve(light, chunk, fan)
    hashes = digests(repaired(rows, found.edits))
    ids = (turns if everyone is None else everyone).select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("c")).distinct()
    out = ids.join(counts(light), "c", "left").join(found.audits, "c", "left").join(hashes, "c", "left")
    kind = turns.schema["conv_id"].dataType
    conv_id = F.when(F.col("c") != "", F.substr("c", F.lit(2)).cast(kind)).alias("conv_id")
    numbers = [F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(conv_id, *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with one row in four damaged, by the CRC-32 of conv_id:turn (nulls read as one space)."""
    text = [F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(text[0], F.lit(":"), text[1]).cast("binary")) % 20
    role = F.when(kind == 4, "user").otherwise(text[2])
    words = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text[3], "[.!?]", "")).otherwise(text[3])
    copies = F.explode(F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return turns.select("conv_id", "turn", role.alias("role"), words.alias("text"), copies.alias("copy")).select("conv_id", "turn", "role", "text")
