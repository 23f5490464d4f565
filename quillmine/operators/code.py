"""Operators over the code index: hashes, symbol tables, imports, diffs, quality and configuration checks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import entropy


def body_hash(body: Column) -> Column:
    """First 16 digits of the SHA-256 of a body without # comments, white space collapsed."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(body, "#[^\\n]*", ""), "[ \\t\\r\\n]+", " "))
    return F.substring(F.sha2(bare, 256), 1, 16)


def symbol_bodies(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbols (path, qualified_name, start_line, end_line) with their source; the slice is by array, so no line rows are made."""
    body = F.array_join(F.slice(F.split("content", "\n", -1), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return symbols.join(files.select("path", "content"), "path").withColumn("body", body).drop("content")


def symbol_table(symbols: DataFrame) -> DataFrame:
    """(name, path): qualified names at their first file, and short names that are unique and no qualified name."""
    own = symbols.groupBy(F.col("qualified_name").alias("name")).agg(F.min("path").alias("path"))
    short = symbols.groupBy("name").agg(F.min("path").alias("path"), F.count("*").alias("n")).where("n = 1").select("name", "path")
    return own.unionByName(short.join(own.select("name"), "name", "left_anti"))


def find_symbol(symbols: DataFrame, name: str) -> DataFrame:
    """The best matches: exact qualified name, then short name, then the name without case, _ and -."""
    plain = lambda c: F.lower(F.regexp_replace(F.element_at(F.split(c, "\\."), -1), "[_-]", ""))
    rank = F.when(F.col("qualified_name") == name, 0).when(F.col("name") == name, 1).when(plain(F.col("qualified_name")) == plain(F.lit(name)), 2)
    out = symbols.withColumn("rank", rank).where("rank IS NOT NULL")
    return out.withColumn("best", F.min("rank").over(Window.partitionBy(F.lit(1)))).where("rank = best").select("path", "qualified_name", "kind", "start_line", "rank")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst) of Python imports: module a.b is {, src/, lib/}a/b{.py, /__init__.py}; the first that exists."""
    stem = F.regexp_replace("name", "\\.", "/")
    tries = F.array(*[F.struct(F.lit(i).alias("prio"), F.concat(F.lit(root), stem, F.lit(tail)).alias("path")) for i, (root, tail) in enumerate((r, t) for r in ("", "src/", "lib/") for t in (".py", "/__init__.py"))])
    rows = imports.select(F.col("path").alias("src"), "name", F.explode(tries).alias("t")).select("src", "name", "t.prio", F.col("t.path").alias("path"))
    found = rows.join(files.select("path").distinct(), "path").groupBy("src", "name").agg(F.min_by("path", "prio").alias("dst"))
    return found.where("src <> dst").select("src", "dst").distinct()


def call_edges(symbols: DataFrame) -> DataFrame:
    """(src, dst) of calls to functions of the same file."""
    calls = symbols.select("path", F.col("qualified_name").alias("src"), F.explode("calls").alias("name"))
    target = symbols.where(F.col("kind").isin("function", "method")).select("path", "name", F.col("qualified_name").alias("dst"))
    return calls.join(target, ["path", "name"]).where("src <> dst").select("src", "dst").distinct()


def duplicates(bodies: DataFrame, least: int = 2) -> DataFrame:
    """Groups of symbols with one normalised body of least lines."""
    rows = bodies.where(F.col("end_line") - F.col("start_line") + 1 >= least).select("qualified_name", body_hash(F.col("body")).alias("hash"))
    return rows.groupBy("hash").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("qualified_name")).alias("members")).where("n > 1")


def dead_code(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions and methods that nothing calls and that are no entry point (main, test_ names, constructors)."""
    entry = F.col("name").isin("main", "__init__") | F.col("name").startswith("test_")
    return symbols.where(F.col("kind").isin("function", "method")).where(~entry).join(edges.select(F.col("dst").alias("qualified_name")).distinct(), "qualified_name", "left_anti").select("path", "qualified_name")


def complexity(bodies: DataFrame) -> DataFrame:
    """0.3 lines + 2 branches + 1.5 nesting + parameters above 4, by symbol."""
    lines = F.split("body", "\n", -1)
    branches = F.size(F.filter(lines, lambda x: x.rlike("^\\s*(if|elif|else|for|while|try|except|case|switch|catch)\\b")))
    first = F.length(F.regexp_extract("body", "^( *)", 1))
    indent = F.array_max(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(F.regexp_extract(x, "^( *)", 1))))
    nesting = F.floor((indent - first) / 4)
    score = 0.3 * F.size(lines) + 2 * branches + 1.5 * nesting + F.greatest(F.lit(0), F.size("parameters") - 4)
    return bodies.where(F.col("kind").isin("function", "method")).select("qualified_name", F.size(lines).alias("lines"), branches.alias("branches"), nesting.alias("nesting"), F.round(score, 4).alias("score"))


def breaking_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(symbol, change, breaking) between two snapshots (symbol, parameters, required, body): removals and new required parameters break."""
    o, n = old.select("symbol", *[F.col(c).alias(f"o_{c}") for c in ("parameters", "required", "body")]), new.select("symbol", *[F.col(c).alias(f"n_{c}") for c in ("parameters", "required", "body")])
    both = o.join(n, "symbol", "full_outer")
    gone = F.size(F.array_except("o_parameters", "n_parameters")) > 0
    added = F.array_except("n_parameters", "o_parameters")
    needed = F.size(F.array_intersect(added, "n_required")) > 0
    change = F.when(F.col("n_body").isNull(), "removed").when(F.col("o_body").isNull(), "added").when(gone, "parameter removed").when(needed, "required parameter added").when(F.size(added) > 0, "optional parameter added").when(F.col("o_body") != F.col("n_body"), "body only")
    return both.select("symbol", change.alias("change")).where("change IS NOT NULL").withColumn("breaking", F.col("change").isin("removed", "parameter removed", "required parameter added"))


def config_duplicates(sections: DataFrame) -> DataFrame:
    """(path, a, b, distance) of keys of one level that are equal, or over 4 characters long and at most 2 edits apart."""
    s = sections.where("kind = 'section'").select("path", "level", "name", "start_line")
    a, b = s.select("path", "level", F.col("name").alias("a"), F.col("start_line").alias("la")), s.select("path", "level", F.col("name").alias("b"), F.col("start_line").alias("lb"))
    d = F.levenshtein("a", "b", 2)
    out = a.join(b, ["path", "level"]).where("la < lb").withColumn("distance", d)
    return out.where((F.col("distance") == 0) | ((F.length("a") > 4) & (F.length("b") > 4) & (F.col("distance") > 0))).select("path", "a", "b", "distance")


#: What credentials of known kinds start with.
SECRET_PREFIXES = ("sk-", "sk_live_", "sk_test_", "ghp_", "gho_", "ghu_", "ghs_", "AKIA", "-----BEGIN", "xox", "xapp-", "eyJ")


def config_secrets(lines: DataFrame) -> DataFrame:
    """(path, line_no, engine) of lines whose value looks secret: a known prefix, a suspicious key, credentials in a URL, or high entropy."""
    value = F.regexp_extract("line", "[=:]\\s*[\"']?([^\\s\"']+)", 1)
    key = F.lower(F.regexp_extract("line", "^\\s*([\\w.-]+)\\s*[=:]", 1))
    harmless = F.lower(value).rlike("^(|changeme|example|true|false|null|none|\\$\\{.*\\}|<.*>)$")
    engines = F.array(
        F.when(reduce(or_, (value.startswith(p) for p in SECRET_PREFIXES)), "prefix"),
        F.when(key.rlike("(password|secret|token|api_?key)"), "key"),
        F.when(value.rlike("^[a-z]+://[^/:@]+:[^/@]+@"), "url"),
        F.when((F.length(value) >= 16) & (entropy(value) > 4.5), "entropy"),
    )
    return lines.where(~harmless).select("path", "line_no", F.explode(F.array_compact(engines)).alias("engine"))


def cross_project(imports: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(project, uses): imports whose module is another project's namespace or below it; prefixes are exploded, so this is an equi-join."""
    parts = F.split("module", "\\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    rows = imports.select("project", F.explode(prefixes).alias("namespace"))
    return rows.join(namespaces.select(F.col("project").alias("uses"), "namespace"), "namespace").where("project <> uses").select("project", "uses").distinct()
