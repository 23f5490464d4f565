"""Listings, scans and reports over a source tree, and pure parts of side-effecting operators."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def glob_regex(pattern: str) -> str:
    """A Java regex for a glob in which * crosses /, and a leading **/ may match nothing."""
    out, rest = "", pattern
    if rest.startswith("**/"):
        out, rest = "(?:.*/)?", rest[3:]
    for c in rest:
        out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
    return f"^{out}$"


def included(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Any include glob, no exclude glob; an exclude without / also names a whole path segment."""
    yes = path.rlike("|".join(map(glob_regex, include)))
    no = path.rlike("|".join(map(glob_regex, exclude))) if exclude else F.lit(False)
    segments = [F.lit(e) for e in exclude if "/" not in e]
    return yes & ~no & (~F.arrays_overlap(F.split(path, "/"), F.array(*segments)) if segments else F.lit(True))


def ignore_globs(lines: DataFrame) -> DataFrame:
    """.gitignore lines as globs: comments, blanks and negations are skipped; a folder gives two."""
    bare = lines.select(F.trim("line").alias("p")).where("p <> '' AND NOT startswith(p, '#') AND NOT startswith(p, '!')")
    folder = F.rtrim(F.col("p"), F.lit("/"))
    return bare.select(F.explode(F.when(F.col("p").endswith("/"), F.array(F.concat(F.lit("**/"), folder, F.lit("/**")), F.concat(folder, F.lit("/**")))).otherwise(F.array("p"))).alias("glob"))


def reindex(old: DataFrame, new: DataFrame) -> DataFrame:
    """(symbol, status) of two snapshots (symbol, hash): unchanged, changed, added or removed."""
    o, n = old.select("symbol", F.col("hash").alias("o")), new.select("symbol", F.col("hash").alias("n"))
    status = F.when(F.col("n").isNull(), "removed").when(F.col("o").isNull(), "added").when(F.col("o") == F.col("n"), "unchanged").otherwise("changed")
    return o.join(n, "symbol", "full_outer").select("symbol", status.alias("status"))


def env_usage(lines: DataFrame, name: str) -> DataFrame:
    """(path, line_no, usage) of lines that name a variable; the first class that fits."""
    line = F.col("line")
    usage = F.when(line.rlike(rf"^\s*(export\s+)?{name}\s*="), "definition").when(line.rlike(rf"os\.(environ|getenv)[^\n]*{name}"), "read").when(line.rlike(rf"process\.env\.{name}"), "read").when(line.rlike(rf"\$\{{?{name}"), "expansion").otherwise("mention")
    return lines.where(line.contains(name)).select("path", "line_no", usage.alias("usage"))


def routes(symbols: DataFrame, decorators: DataFrame) -> DataFrame:
    """(route, method, path) from page files and from decorator rows (path, decorator)."""
    stem = F.regexp_extract("path", r"^(?:.*/)?app/(.*?)/?(page|route|layout)\.[jt]sx?$", 1)
    kind = F.regexp_extract("path", r"(page|route|layout)\.[jt]sx?$", 1)
    pages = symbols.select("path").distinct().where(kind != "").select(F.concat(F.lit("/"), stem).alias("route"), F.upper(kind).alias("method"), "path")
    m = F.regexp_extract("decorator", r"@(Get|Post|Put|Delete|Patch)Mapping\(\"([^\"]+)\"", 1)
    mapped = decorators.where(m != "").select(F.regexp_extract("decorator", r"Mapping\(\"([^\"]+)\"", 1).alias("route"), F.upper(m).alias("method"), "path")
    return pages.unionByName(mapped).dropDuplicates(["route", "method", "path"])


def entry_points(symbols: DataFrame, callers: DataFrame) -> DataFrame:
    """(qualified_name, score): feature sum over 5, one at most; kept above 0.1."""
    n = callers.groupBy(F.col("dst").alias("qualified_name")).agg(F.count("*").alias("n"))
    s = symbols.where(F.col("kind").isin("function", "method")).join(n, "qualified_name", "left")
    score = F.when(F.col("name") == "main", 3).otherwise(0) + F.when(F.col("n").isNull(), 1).otherwise(0) + F.when(F.col("path").rlike("(^|/)(main|app|server|cli)\\."), 1).otherwise(0)
    return s.select("qualified_name", F.least(F.lit(1.0), score / 5).alias("score")).where("score > 0.1")


def impacted_tests(edges: DataFrame, symbols: DataFrame, changed: list[str]) -> DataFrame:
    """(test, reason) of test files: changed themselves, named after a changed file, or callers of its symbols."""
    tests = symbols.select("path").distinct().where(F.col("path").rlike("(^|/)test_|_test\\."))
    stem = F.regexp_extract("path", "(?:^|/)(?:test_)?([^/]+?)(?:_test)?\\.[a-z]+$", 1)
    stems = F.array(*[F.lit(re.sub(r"\.\w+$", "", c.rsplit("/", 1)[-1])) for c in changed])
    direct = tests.select(F.col("path").alias("test"), F.when(F.col("path").isin(changed), "changed").when(F.array_contains(stems, stem), "name").alias("reason"))
    touched = symbols.where(F.col("path").isin(changed)).select(F.col("qualified_name").alias("dst"))
    callers = edges.join(touched, "dst", "left_semi").select(F.col("src").alias("qualified_name")).join(symbols, "qualified_name").join(tests, "path", "left_semi").select(F.col("path").alias("test"), F.lit("caller").alias("reason"))
    return direct.where("reason IS NOT NULL").unionByName(callers).groupBy("test").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def context_pack(values: DataFrame, budget: int) -> DataFrame:
    """Greedy choice of rows (id, value, cost) by value over cost within a budget; the fold is over one sorted list of candidates that the caller has cut to a top-k."""
    rows = values.agg(F.array_sort(F.collect_list(F.struct((-F.col("value") / F.col("cost")).alias("k"), "id", "cost"))).alias("r"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<bigint>").alias("ids"))
    step = lambda a, x: F.struct(F.when(x["cost"] <= a["left"], a["left"] - x["cost"]).otherwise(a["left"]).alias("left"), F.when(x["cost"] <= a["left"], F.concat(a["ids"], F.array(x["id"]))).otherwise(a["ids"]).alias("ids"))
    return rows.select(F.aggregate("r", start, step).alias("a")).select(F.posexplode("a.ids").alias("place", "id"))


def backward_slice(functions: DataFrame) -> DataFrame:
    """(id, line) that the variable at a line depends on, for rows (id, source, variable, line): definitions followed back, with the control flow around them."""

    def lines(source: str, variable: str, line: int) -> list[int]:
        try:
            nodes = list(ast.walk(ast.parse(source)))
        except SyntaxError:
            return list(range(max(1, line - 20), line + 1))
        names = lambda n, kind: {x.id for x in ast.walk(n) if isinstance(x, ast.Name) and isinstance(x.ctx, kind)}
        defs = [(n.lineno, names(n, ast.Store), names(n, ast.Load)) for n in nodes if isinstance(n, (ast.Assign, ast.AugAssign, ast.AnnAssign))]
        flow = [(n.lineno, n.end_lineno, names(n.test if hasattr(n, "test") else n.iter, ast.Load), names(n.target, ast.Store) if hasattr(n, "target") else set()) for n in nodes if isinstance(n, (ast.If, ast.While, ast.For))]
        found, todo = {line}, [(variable, line)]
        while todo:
            name, at = todo.pop()
            new = [(k, used) for k, made, used in defs if name in made and k <= at and k not in found]
            new += [(a, used) for a, b, used, made in flow if a not in found and (a < at <= b or (name in made and a <= at))]
            for k, used in new:
                found.add(k)
                todo += [(u, k) for u in used] + [(name, k)]
        return sorted(found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(i, k) for i, s, v, n in zip(batch["id"], batch["source"], batch["variable"], batch["line"]) for k in lines(s, v, n)], columns=["id", "line"])

    return functions.select("id", "source", "variable", "line").mapInPandas(run, "id long, line int")


def tool_router(query: str, tools: DataFrame, k: int = 5) -> DataFrame:
    """Tools (name, doc) by the share of the query's words of three letters or more that the doc contains."""
    words = [w for w in dict.fromkeys(re.findall(r"\w+", query.lower())) if len(w) > 2]
    hits = sum((F.when(F.lower("doc").contains(w), 1).otherwise(0) for w in words), F.lit(0))
    return tools.select("name", F.round(hits / max(1, len(words)), 6).alias("score")).orderBy(F.desc("score"), "name").limit(k)


#: Allocation rules for Java bodies, pattern, weight and reason.
JAVA_RULES = (
    (r"\bnew\s+[A-Z_][A-Za-z0-9_$.<>]*\s*\(", 5.0, "object construction"),
    (r"\bnew\s+(?:ArrayList|LinkedList|HashMap|LinkedHashMap|ConcurrentHashMap|HashSet|LinkedHashSet|TreeMap|TreeSet|StringBuilder|StringBuffer|BigDecimal|BigInteger)(?:<[^>]*>)?\s*\(", 7.0, "collection/buffer construction"),
    (r"\bnew\s+[A-Za-z_][A-Za-z0-9_$.<>?,\s]*\[", 4.0, "array allocation"),
    (r"\bString\.format\s*\(|\.formatted\s*\(", 6.0, "string formatting"),
    (r"\.(?:stream|parallelStream)\s*\(|\bCollectors\.", 5.0, "stream pipeline"),
    (r"\bOptional\.(?:of|ofNullable|empty)\s*\(", 4.0, "optional wrapper"),
    (r"\b(?:Integer|Long|Double|Float|Short|Byte|Boolean|Character)\.valueOf\s*\(", 3.0, "boxing helper"),
    (r"\bPattern\.compile\s*\(", 5.0, "regex compilation"),
    (r"\bnew\s+[A-Z][A-Za-z0-9_]*(?:Exception|Error)\s*\(", 4.0, "exception allocation"),
)


def java_hotspots(bodies: DataFrame) -> DataFrame:
    """(qualified_name, score) by weighted rule hits."""
    score = sum((F.regexp_count("body", F.lit(p)) * w for p, w, _ in JAVA_RULES), F.lit(0.0))
    return bodies.select("qualified_name", score.alias("score")).where("score > 0")


def docker_report(lines: DataFrame) -> DataFrame:
    """(path, line_no, issue) of Dockerfile lines (path, line_no, line): base images without a tag or at latest."""
    image = F.regexp_extract("line", r"(?i)^\s*FROM\s+(\S+)", 1)
    issue = F.when(image.endswith(":latest"), "latest").when(~image.contains(":") & (image != "scratch"), "untagged")
    return lines.where(image != "").select("path", "line_no", issue.alias("issue")).where("issue IS NOT NULL")


def config_orphans(keys: DataFrame, code: DataFrame) -> DataFrame:
    """(key, kind): keys (key) that no code token names, and upper-case tokens that code reads from the environment but no key defines."""
    tokens = code.select(F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\w+"), F.lit(0)))).alias("key")).distinct()
    ghosts = code.select(F.explode(F.regexp_extract_all("line", F.lit(r"(?:getenv\(|environ\[|process\.env\.)[\"']?([A-Z_]+)"), F.lit(1))).alias("key")).distinct()
    orphan = keys.select("key").distinct().join(tokens, "key", "left_anti").withColumn("kind", F.lit("orphan"))
    return orphan.unionByName(ghosts.join(keys, "key", "left_anti").withColumn("kind", F.lit("ghost")))


def migrations(files: DataFrame) -> DataFrame:
    """(table, column, type) after replaying SQL files (folder, path, content) in path order; the fold needs a folder's files together."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        tables: dict[str, dict[str, str]] = {}
        for content in group.sort_values("path")["content"]:
            for statement in re.sub(r"--[^\n]*", "", content).split(";"):
                s = " ".join(statement.split())
                if m := re.match(r"(?i)create table (?:if not exists )?(\w+) ?\((.*)\)$", s):
                    parts = [p.strip() for p in re.split(r",(?![^(]*\))", m[2])]
                    tables[m[1]] = {p.split()[0]: p.split()[1].upper() for p in parts if len(p.split()) > 1 and p.split()[0].upper() not in ("PRIMARY", "FOREIGN", "UNIQUE", "CONSTRAINT", "CHECK")}
                elif m := re.match(r"(?i)alter table (\w+) add (?:column )?(\w+) (\w+)", s):
                    tables.setdefault(m[1], {})[m[2]] = m[3].upper()
                elif m := re.match(r"(?i)alter table (\w+) drop (?:column )?(\w+)", s):
                    tables.get(m[1], {}).pop(m[2], None)
                elif m := re.match(r"(?i)drop table (?:if exists )?(\w+)", s):
                    tables.pop(m[1], None)
        return pd.DataFrame([(t, c, k) for t, columns in tables.items() for c, k in columns.items()], columns=["table", "column", "type"])

    return files.groupBy("folder").applyInPandas(run, "table string, column string, type string")


def chunks(docs: DataFrame, window: int = 64, least: int = 128, most: int = 1024) -> DataFrame:
    """(id, place, start, size, fingerprint) of content-defined chunks of docs (id, text): a cut where the rolling hash of window bytes is 0 modulo 256."""
    import hashlib

    import numpy as np

    def cut(data: bytes) -> list[int]:
        x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        weights = np.array([pow(263, window - 1 - k, 1 << 32) for k in range(window)], np.uint64)
        rolled = np.convolve(x, weights[::-1])[window - 1 : len(x)] & np.uint64(0xFFFFFFFF) if len(x) >= window else np.zeros(0, np.uint64)
        marks = np.flatnonzero(((rolled * np.uint64(2654435761)) >> np.uint64(16)) % np.uint64(256) == 0) + window
        edges = [0]
        while len(data) - edges[-1] > most or (len(marks) and marks[-1] >= edges[-1] + least):
            k = np.searchsorted(marks, edges[-1] + least)
            nxt = min(int(marks[k]) if k < len(marks) else len(data), edges[-1] + most)
            if nxt >= len(data):
                break
            edges.append(nxt)
        return [*edges, len(data)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, t in zip(batch["id"], batch["text"]):
                data = (t or "").encode()
                edges = cut(data) if data else [0]
                rows += [(i, n, a, b - a, hashlib.sha256(data[a:b]).hexdigest()[:12]) for n, (a, b) in enumerate(zip(edges, edges[1:]))]
            yield pd.DataFrame(rows, columns=["id", "place", "start", "size", "fingerprint"])

    return docs.select("id", "text").mapInPandas(run, "id long, place int, start long, size long, fingerprint string")


def chunk_registry(parts: DataFrame) -> DataFrame:
    """(fingerprint, seen) of chunks seen twice or more."""
    return parts.groupBy("fingerprint").agg(F.count("*").alias("seen")).where("seen > 1")


def summary_bullets(rows: DataFrame) -> DataFrame:
    """(id, heading, bullet) of bullet lines below the last heading before them; rows (id, text)."""
    lines = rows.select("id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    heading = F.last(F.when(F.col("line").rlike("^#+ "), F.regexp_replace("line", "^#+ ", "")), ignorenulls=True).over(Window.partitionBy("id").orderBy("n"))
    return lines.withColumn("heading", heading).where(F.col("line").rlike("^\\s*[-*] ")).select("id", "heading", F.regexp_replace("line", "^\\s*[-*] ", "").alias("bullet"))


def extractions(raw: DataFrame, kinds: list[str], most: int = 3) -> DataFrame:
    """Valid items of a JSON array per row (id, raw): allowed types, a title, most items; broken JSON gives none."""
    items = F.from_json("raw", "array<struct<type:string,title:string,content:string>>")
    good = F.filter(items, lambda x: x["type"].isin(kinds) & (F.length(F.trim(x["title"])) > 0))
    return raw.select("id", F.explode(F.slice(good, 1, most)).alias("i")).select("id", "i.type", F.substring("i.title", 1, 120).alias("title"), "i.content")


def contradictions(rules: DataFrame, text: str, opposites: list[tuple[str, str]], most: int = 5) -> DataFrame:
    """(id, term) of rule rows (id, content) that hold the opposite of a term in text."""
    wanted = [b for a, b in opposites if re.search(a, text.lower())] + [a for a, b in opposites if re.search(b, text.lower())]
    parts = [rules.where(F.lower("content").rlike(t)).orderBy("id").limit(most).select("id", F.lit(t).alias("term")) for t in wanted]
    out = parts[0] if parts else rules.select("id", F.lit("").alias("term")).limit(0)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["id"])


def capture_range(captures: DataFrame, first: int, last: int) -> DataFrame:
    """(id, part): lines first to last, from 1, of captures (id, output)."""
    return captures.select("id", F.array_join(F.slice(F.split("output", "\n", -1), first, last - first + 1), "\n").alias("part"))


def splice(lines: DataFrame, first: int, last: int, new: list[str]) -> DataFrame:
    """lines (line_no, line) with first to last replaced by new, numbered anew: the pure part of a symbol edit."""
    spark = lines.sparkSession
    shift = len(new) - (last - first + 1)
    added = spark.createDataFrame([(first + k, x) for k, x in enumerate(new)], "line_no int, line string")
    before = lines.where(F.col("line_no") < first)
    after = lines.where(F.col("line_no") > last).withColumn("line_no", F.col("line_no") + shift)
    return before.unionByName(added).unionByName(after)
