"""Memory engine: scoring, lifecycle rules and reads over an observations table.

Every operator takes now (epoch seconds) as an argument and returns a full relation; counters such as access_count are
derived from logs before (see plans.bindings).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..functions.columns import content_hash, jaccard, pick, space_tokens
from .graph import cut


def age_days(now: int, epoch: Column) -> Column:
    return (F.lit(now) - epoch) / rules.DAY


def observation_score(now: int) -> Column:
    age, n = age_days(now, F.col("created_at_epoch")), F.col("access_count")
    recency = F.when(age < 1, 1.0).when(age < 7, 0.8).when(age < 30, 0.5).when(age < 90, 0.2).otherwise(0.1)
    access = F.when(n == 0, 0.0).when(n == 1, 0.3).when(n < 5, 0.6).otherwise(1.0)
    return F.round(0.4 * recency + 0.3 * access + 0.3 * pick(F.col("type"), rules.TYPE_SCORES, 0.2), 3)


def recent_index(obs: DataFrame, now: int, limit: int = 30) -> DataFrame:
    """Best by score, then newest, then id."""
    scored = obs.where("NOT archived").select("id", "type", "title", "created_at_epoch", observation_score(now).alias("score"))
    return scored.orderBy(F.desc("score"), F.desc("created_at_epoch"), "id").limit(limit)


def top_observations(obs: DataFrame, now: int, limit: int = 20) -> DataFrame:
    """The pre-limit by accesses and age comes first: it decides what can be ranked at all."""
    pool = obs.where("NOT archived").orderBy(F.desc("access_count"), F.desc("created_at_epoch"), "id").limit(max(3 * limit, 60))
    return pool.select("id", "access_count", observation_score(now).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def relevance_decay(obs: DataFrame, config: DataFrame, now: int) -> DataFrame:
    """(id, relevance_score) of rows whose score moves by over 0.001; types without a config row are untouched."""
    base = F.pow("decay_rate", age_days(now, F.col("created_at_epoch"))) + F.col("boost_on_access") * F.col("access_count")
    new = F.greatest("min_score", F.least(F.lit(1.0), base))
    out = obs.where("NOT archived").join(F.broadcast(config), "type").withColumn("new", new)
    return out.where(F.abs(F.col("new") - F.col("relevance_score")) > 0.001).select("id", F.round("new", 4).alias("relevance_score"))


def decay_candidates(obs: DataFrame, now: int) -> DataFrame:
    """(id, type, reason): the age rule claims rows first, then TTL (immune rows too), then the zero-access rules."""
    old = (F.col("created_at_epoch") < now - 90 * rules.DAY) & (F.coalesce("last_accessed_epoch", F.lit(0)) < now - 30 * rules.DAY) & (F.col("access_count") < 3) & ~F.col("decay_immune")
    reason = F.when(old, "age").when(F.col("expires_at_epoch") < now, "ttl-expired")
    for kind, days in rules.ZERO_ACCESS_DAYS.items():
        reason = reason.when(~F.col("decay_immune") & (F.col("type") == kind) & (F.col("access_count") == 0) & (F.col("created_at_epoch") < now - days * rules.DAY), f"zero-access {kind} >{days}d")
    return obs.where("NOT archived").select("id", "type", reason.alias("reason")).where("reason IS NOT NULL")


def roi(obs: DataFrame, now: int) -> DataFrame:
    """Expected value of keeping each row: p_hit, tokens_stored, roi."""
    since = F.greatest(F.lit(0.0), age_days(now, F.coalesce("last_accessed_epoch", "created_at_epoch")))
    p = F.least(F.lit(1.0), F.exp(-0.05 * since) * (1.0 + 0.1 * F.col("access_count")))
    factor = pick(F.col("type"), rules.ROI_MULTIPLIERS, 1.0)
    factor = F.when(F.col("decay_immune"), F.greatest(factor, F.lit(5.0))).otherwise(factor)
    stored = F.greatest(F.lit(1), F.floor((F.length(F.coalesce("title", F.lit(""))) + F.length(F.coalesce("content", F.lit("")))) / 4))
    return obs.where("NOT archived").select("id", "type", F.round(p, 4).alias("p_hit"), stored.alias("tokens_stored"), F.round(200 * p * 30 * factor - stored, 3).alias("roi"))


def roi_stats(obs: DataFrame, now: int) -> DataFrame:
    """By type and in all (type null). The mean is of whole thousandths, so it does not depend on the order of addition."""
    mean = F.floor(F.sum(F.round(F.col("roi") * 1000).cast("long")) * F.lit(10.0) / F.count("*") + 0.5) / 10000
    return roi(obs, now).rollup("type").agg(F.count("*").alias("n"), F.sum("tokens_stored").alias("tokens_stored"), mean.alias("avg_roi"), F.count_if(F.col("roi") < 0).alias("negative"))


def promotions(obs: DataFrame, now: int) -> DataFrame:
    """(id, from_type, to_type) of every rule that matches a row accessed in the last 30 days and raises its rank."""
    spark = obs.sparkSession
    table = spark.createDataFrame([(a, n, b) for a, n, b in rules.PROMOTIONS if rules.PROMOTION_RANK[b] > rules.PROMOTION_RANK[a]], "type string, least long, to_type string")
    live = obs.where("NOT archived").where(F.col("last_accessed_epoch") >= now - 30 * rules.DAY)
    return live.join(F.broadcast(table), "type").where("access_count >= least").select("id", F.col("type").alias("from_type"), "to_type")


def validity(outcomes: DataFrame) -> DataFrame:
    """Beta(2, 1) posterior of outcomes (obs_id, ok): alpha, beta, validity and state."""
    out = outcomes.groupBy("obs_id").agg((2 + F.count_if("ok")).alias("alpha"), (1 + F.count_if(~F.col("ok"))).alias("beta"))
    out = out.withColumn("validity", F.round(F.col("alpha") / (F.col("alpha") + F.col("beta")), 6))
    return out.withColumn("state", F.when(F.col("validity") < 0.4, "quarantine").when(F.col("validity") < 0.6, "stale-suspected").otherwise("valid"))


def consistency_stats(obs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows and mean validity by state; rows without outcomes count at 2/3."""
    out = obs.select(F.col("id").alias("obs_id")).join(validity(outcomes), "obs_id", "left")
    return out.groupBy(F.coalesce("state", F.lit("valid")).alias("state")).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("validity", F.lit(2 / 3))), 6).alias("mean_validity"))


def continuity(obs: DataFrame, now: int) -> DataFrame:
    """By project: total, stale (unread for 30 days and not immune), score in whole per cent and label."""
    unread = (F.coalesce("last_accessed_epoch", "created_at_epoch") < now - 30 * rules.DAY) & ~F.col("decay_immune")
    out = obs.where("NOT archived").groupBy("project_root").agg(F.count("*").alias("total"), F.count_if(unread).alias("stale"))
    out = out.withColumn("score", F.floor(100 * (F.col("total") - F.col("stale")) / F.col("total")))
    return out.withColumn("label", F.when(F.col("score") >= 80, "Excellent").when(F.col("score") >= 60, "Good").when(F.col("score") >= 40, "Fair").otherwise("Poor"))


def memory_stats(obs: DataFrame) -> DataFrame:
    """One pass of grouping sets: by type, by project, in all."""
    return obs.groupingSets([[F.col("type")], [F.col("project_root")], []], "type", "project_root").agg(F.count("*").alias("n"), F.sum("access_count").alias("accesses"))


def hash_duplicates(obs: DataFrame) -> DataFrame:
    """Groups of rows with one content hash: the smallest id stays."""
    out = obs.select("id", content_hash(F.col("content")).alias("content_hash")).where("content_hash IS NOT NULL")
    return out.groupBy("content_hash").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies")).where("copies > 1")


def dedup_sweep(obs: DataFrame) -> DataFrame:
    """(id, kept_id) of rows to archive: all but the first of each project and content hash."""
    key = obs.select("id", "project_root", content_hash(F.col("content")).alias("h")).where("h IS NOT NULL")
    first = key.groupBy("project_root", "h").agg(F.min("id").alias("kept_id"), F.count("*").alias("n")).where("n > 1")
    return key.join(first, ["project_root", "h"]).where("id <> kept_id").select("id", "kept_id")


def title_pairs(rows: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b, similarity) of rows (id, title) whose titles' token sets have Jaccard similarity of threshold or more.

    Prefix filter: tokens are ordered rarest first, and a pair that similar shares one of the first
    size - ceil(threshold * size) + 1 tokens of both, so candidates come from an equi-join. Equal titles are one row,
    that of smallest id; title_members names the rows it stands for.
    """
    named = rows.select("id", F.array_join(F.array_sort(space_tokens(F.col("title"))), " ").alias("name")).where("name <> ''")
    sets = named.groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "n", F.split("name", " ").alias("tokens"))
    parts = sets.select("id", F.explode("tokens").alias("token"))
    # tokens become numbers, written once, as both sides read them
    counts = cut(parts.groupBy("token").agg(F.count("*").alias("df")).withColumn("code", F.monotonically_increasing_id()))
    ranked = cut(parts.join(counts, "token").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "code"))), lambda x: x["code"]).alias("tokens")))
    size = F.size("tokens")
    head = F.slice("tokens", F.lit(1), (size - F.ceil(size * F.lit(threshold) - 1e-9) + 1).cast("int"))
    keyed = ranked.select("id", "tokens", F.explode(head).alias("token"))
    a, b = keyed.select(F.col("id").alias("a"), F.col("tokens").alias("ta"), "token"), keyed.select(F.col("id").alias("b"), F.col("tokens").alias("tb"), "token")
    fits = (F.size("ta") >= F.size("tb") * threshold) & (F.size("tb") >= F.size("ta") * threshold)
    # both sides are in one order, so a pair is made at its first common token alone
    pairs = a.join(b, "token").where("a < b").where(fits).where(F.get(F.array_intersect("ta", "tb"), F.lit(0)) == F.col("token"))
    return pairs.select("a", "b", F.round(jaccard(F.col("ta"), F.col("tb")), 6).alias("similarity")).where(F.col("similarity") >= threshold)


def title_members(rows: DataFrame) -> DataFrame:
    """(id, representative, n) of every row (id, title): the smallest id with the same token set, and how many rows have it. A title without tokens is like no other: n is 1."""
    named = rows.select("id", F.array_join(F.array_sort(space_tokens(F.col("title"))), " ").alias("name"))
    sets = named.where("name <> ''").groupBy("name").agg(F.min("id").alias("representative"), F.count("*").alias("n"))
    return named.join(sets, "name", "left").select("id", F.coalesce("representative", "id").alias("representative"), F.coalesce("n", F.lit(1)).alias("n"))


def title_links(rows: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(id, representative, n, links) of every row: links counts the other rows of similarity threshold or more, equal titles among them."""
    members = title_members(rows)
    pairs = title_pairs(rows, threshold)
    sizes = members.where("id = representative").select(F.col("id").alias("b"), F.col("n").alias("m"))
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    more = both.join(sizes, "b").groupBy(F.col("a").alias("representative")).agg(F.sum("m").alias("m"))
    return members.join(more, "representative", "left").select("id", "representative", "n", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("links"))


def timeline(obs: DataFrame, anchor_id: int, hours: int = 24) -> DataFrame:
    """Rows within hours of the anchor row."""
    at = F.broadcast(obs.where(F.col("id") == anchor_id).select(F.col("created_at_epoch").alias("anchor")).limit(1))
    near = F.abs(F.col("created_at_epoch") - F.col("anchor")) <= hours * 3600
    return obs.join(at, near).select("id", "type", (F.col("created_at_epoch") - F.col("anchor")).alias("offset_s"))


def by_file(obs: DataFrame, tail: str) -> DataFrame:
    return obs.where((F.col("file_path") == tail) | F.col("file_path").endswith("/" + tail)).select("id", "file_path", "importance", "created_at_epoch")


def symbol_links(obs: DataFrame) -> DataFrame:
    """Undirected links of rows of one project and symbol, as a star on the smallest id instead of all pairs."""
    hub = obs.groupBy("project_root", "symbol").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    return obs.join(hub, ["project_root", "symbol"]).where("id <> hub").select(F.col("hub").alias("source_id"), F.col("id").alias("target_id"))


def health(obs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Counts of incomplete rows, and of rows with a vector."""
    out = obs.join(vectors.select(F.col("id"), F.lit(1).alias("has")), "id", "left")
    return out.agg(F.count("*").alias("total"), F.count_if((F.length(F.trim("content")) < 40)).alias("incomplete"), F.count("has").alias("indexed"), F.round(100.0 * F.count("has") / F.count("*"), 4).alias("coverage_pct"))


def session_budget(obs: DataFrame, budget: int = 200_000) -> DataFrame:
    """Tokens of each session's rows against a budget, with the level it reaches."""
    out = obs.groupBy("session_id").agg(F.sum(F.floor(F.length("content") / 4)).alias("tokens"))
    pct = F.round(100.0 * F.col("tokens") / budget, 4)
    return out.select("session_id", "tokens", pct.alias("pct"), F.when(pct >= 75, "critical").when(pct >= 50, "warning").otherwise("ok").alias("level"))


def corpus(obs: DataFrame, types: list[str], symbols: list[str]) -> DataFrame:
    """Ids of a corpus: any of the types, or any of the symbols."""
    return obs.where(F.col("type").isin(types) | F.col("symbol").isin(symbols)).select("id", "type", "symbol")


def archive_preview(obs: DataFrame, now: int) -> DataFrame:
    """Rows that decay would archive, by reason."""
    return decay_candidates(obs, now).groupBy("reason").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def latest_per_session(obs: DataFrame, most: int = 3) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("created_at_epoch"), "id"))
    return obs.select("id", "session_id", rank.alias("place")).where(F.col("place") <= most)
