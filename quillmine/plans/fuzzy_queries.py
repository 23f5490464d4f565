"""Queries of fuzzy names and of names in lines, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import containment as C
from ..operators import fuzzy as Z
from .bindings import observations, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def words(s, d, name, pattern="[a-z_]{3,}"):
    return table(s, d, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("name")).distinct()


def fuzzy_titles(s, d):
    """Pairs of different titles with a ratio of 0.9 or more, named by the smallest rows that bear them, and how many do."""
    heads = observations(s, d).where("title <> ''").groupBy(F.col("title").alias("name")).agg(F.min("id").alias("id"), F.count("*").alias("members"))
    found = Z.close_pairs(heads, None, 0.9)
    side = lambda x: heads.select(F.col("name").alias(x), F.col("id").alias(f"id_{x}"), F.col("members").alias(f"members_{x}"))
    return found.join(side("a"), "a").join(side("b"), "b").select("id_a", "id_b", "members_a", "members_b", F.round("ratio", 6).alias("ratio"))


def fuzzy_names(s, d):
    """For every word of the benchmark the three closest other words of all documents, by a ratio of 0.8 or more."""
    found = Z.close_matches(words(s, d, "benchmark"), words(s, d, "documents"), 3, 0.8)
    return found.select("word", "match", F.round("ratio", 6).alias("ratio"), "rank")


def names(s, d):
    """Words of part names, whole part names, and words of the benchmark of six letters or more."""
    parts = table(s, d, "part").select("p_name").distinct()
    return parts.select(F.explode(F.split("p_name", " ")).alias("name")).unionByName(parts.select(F.col("p_name").alias("name"))).unionByName(words(s, d, "benchmark", "[a-z_]{6,}"))


def names_in_lines(s, d):
    """Every line of every document with the names that it contains, wherever in a word, and their first place."""
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("number", "line"))
    found = C.contained(lines.select(F.struct("doc_id", "number").alias("id"), "line"), names(s, d))
    return found.select(F.col("id.doc_id").alias("doc_id"), F.col("id.number").alias("line_number"), "name", F.col("at").cast("long").alias("place"))


QUERIES |= {"fuzzy_titles": fuzzy_titles, "fuzzy_names": fuzzy_names, "names_in_lines": names_in_lines}
ORACLES["names_in_lines"] = """WITH n AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part UNION SELECT p_name FROM part UNION SELECT unnest(regexp_extract_all(lower(text), '[a-z_]{6,}')) FROM benchmark),
t AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_number FROM t)
SELECT doc_id, line_number, name, strpos(line, name) AS place FROM l JOIN n ON contains(line, name) WHERE name <> ''"""
