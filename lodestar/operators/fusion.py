"""Rank fusion.

Rankings are rows (query_id, engine, engine_ord, weight, rank, title, url, snippet, published_at[, meta]);
``rank`` is the place in the engine's list, counted before anything is dropped. Fusing is one aggregation keyed by
query and normalised address, so it shuffles once and combines on the map side. What depends on the order
of a query's results (title duplicates, diversity) runs per query, on lists of at most some hundreds.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.config import Config
from lodestar.functions import text, url

ORDER = ("score", "best_rank", "title", "seq")


def ordering() -> list[Column]:
    """Best first: score, best rank, title (collated), first seen."""
    return [F.desc("score"), F.asc("best_rank"), F.asc(F.collate("title", "UNICODE")), F.asc("seq")]


def keyed(rankings: DataFrame) -> DataFrame:
    """Rankings with the parsed address ``u``; rows that are no web pages go, and a list keeps its first row of a page."""
    parsed = url.with_url(rankings.filter("weight > 0"), "url", "u").filter("u is not null")
    first = Window.partitionBy("query_id", "engine", "engine_ord", "u.key").orderBy("rank")
    return parsed.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def sanitise(rankings: DataFrame) -> DataFrame:
    """Rows without a title of two characters or a web address go, repeated pages of a list too, and ranks close up."""
    titled = rankings.withColumn("title", F.trim("title")).filter(F.length("title") >= 2).withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    place = Window.partitionBy("query_id", "engine", "engine_ord").orderBy("rank")
    return keyed(titled).withColumn("rank", F.row_number().over(place)).withColumn("url", F.col("u.key")).drop("u")


def fuse(
    rankings: DataFrame,
    k: int = 60,
    consensus_bonus: float = 0.12,
    recency_boost: float = 1.0,
    recency_window_s: int = 0,
    now: Column | None = None,
    promote: Iterable[str] = (),
    demote: Iterable[str] = (),
) -> DataFrame:
    """One row per query and page: score, best_rank, engines by contribution, merged title, snippet, date and meta."""
    meta = "meta" in rankings.columns
    rows = keyed(rankings).withColumn("seq", F.col("engine_ord").cast("long") * 1_000_000 + F.col("rank")).withColumn("part", F.col("weight").cast("double") / (F.lit(float(k)) + F.col("rank")))
    # the longest wins, and the first of the longest; a blank title gives way to the path
    longest = lambda c: F.max_by(F.trim(F.coalesce(c, F.lit(""))), F.struct(F.length(F.coalesce(c, F.lit(""))), -F.col("seq")))
    aggregates = [
        F.sum("part").alias("total"),
        F.countDistinct("engine").alias("n_engines"),
        F.min("rank").cast("int").alias("best_rank"),
        F.min("seq").alias("seq"),
        longest("title").alias("title"),
        longest("snippet").alias("snippet"),
        F.min_by("published_at", F.when(F.col("published_at").isNotNull(), F.col("seq"))).alias("published_at"),
        F.array_sort(F.collect_list(F.struct((-F.col("part")).alias("p"), "seq", "engine"))).alias("parts"),
        F.first("u.domain").alias("source"),
        F.first("u.host").alias("host"),
        F.first("u.path").alias("path"),
    ]
    if meta:
        aggregates.append(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("meta", F.create_map().cast("map<string,string>")).alias("m")))).alias("metas"))
    out = rows.groupBy("query_id", F.col("u.key").alias("url")).agg(*aggregates)
    score = F.col("total") + F.when(F.col("n_engines") > 1, F.lit(float(consensus_bonus)) * (F.col("n_engines") - 1)).otherwise(F.lit(0.0))
    if recency_boost != 1 and recency_window_s > 0:
        recent = F.unix_seconds(now if now is not None else F.current_timestamp()) - F.unix_seconds(F.col("published_at").cast("timestamp")) <= recency_window_s
        score = score * F.when(recent, F.lit(float(recency_boost))).otherwise(F.lit(1.0))
    for domains, factor in ((promote, 1.15), (demote, 0.5)):
        names = [d.lower() for d in domains]
        if names:
            score = score * F.when(F.col("source").isin(names), F.lit(factor)).otherwise(F.lit(1.0))
    columns = ["query_id", "url", F.when(F.col("title") == "", F.col("path")).otherwise(F.col("title")).alias("title"), "snippet", "source", "host", F.array_distinct(F.transform("parts", lambda x: x.engine)).alias("engines"), "best_rank", F.round(score, 6).alias("score"), "published_at", "seq"]
    if meta:
        columns.append(F.aggregate("metas", F.create_map().cast("map<string,string>"), lambda a, x: F.map_concat(a, x.m)).alias("meta"))
    return out.select(*columns)


def dedupe_titles(fused: DataFrame, threshold: float = 0.82) -> DataFrame:
    """Near-equal titles of one domain fall to the best-placed one, which takes over their engines and a quarter of their
    scores. The greedy fold depends on the order within a query and domain, and runs on such groups.

    Adds ``pos``, the order before the fold: scores that grow do not move a result."""
    if threshold <= 0:
        return placed(fused)
    ranked = placed(fused).withColumn("_s", text.shingles(F.col("title")))
    schema = ranked.schema

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").reset_index(drop=True)
        kept: list[int] = []
        sets = [frozenset(s) if s is not None else frozenset() for s in rows["_s"]]
        engines, scores = [list(e) for e in rows["engines"]], rows["score"].tolist()
        for i, own in enumerate(sets):
            for j in kept:
                both = len(own & sets[j])
                if own and sets[j] and both / (len(own) + len(sets[j]) - both) >= threshold:
                    engines[j] = list(dict.fromkeys(engines[j] + engines[i]))
                    scores[j] = round(scores[j] + scores[i] * 0.25, 6)
                    break
            else:
                kept.append(i)
        rows["engines"], rows["score"] = engines, scores
        return rows.iloc[kept]

    return ranked.groupBy("query_id", "source").applyInPandas(fold, schema).drop("_s")


def placed(fused: DataFrame) -> DataFrame:
    """``pos``: the place of each result in its query."""
    return fused.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*ordering())))


def cap_domains(results: DataFrame, most: int = 3) -> DataFrame:
    """Results beyond ``most`` of a domain move to the back in their order; ``pos`` is renewed."""
    if most <= 0:
        return results
    within = results.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("pos")))
    return within.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy((F.col("_n") > most).cast("int"), "pos"))).drop("_n")


def limit_per_query(results: DataFrame, most: int) -> DataFrame:
    """The first ``most`` results of each query; all if it isn't positive."""
    if most <= 0:
        return results
    return results.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).filter(F.col("pos") <= most)


def fused_results(rankings: DataFrame, limit: int = 12, config: Config | None = None, **options: object) -> DataFrame:
    """Fusion, title duplicates, domain cap and limit in one."""
    c = config or Config()
    rows = fuse(rankings, k=c.rrf_k, consensus_bonus=c.consensus_bonus, **options)
    return limit_per_query(cap_domains(dedupe_titles(rows, c.title_threshold), c.max_per_domain), limit)


def diversify(results: DataFrame, window: int = 3) -> DataFrame:
    """Greedy interleaving: next comes the first result whose domain isn't among the last ``window``, or else the first. ``pos`` is renewed."""

    def weave(rows: pd.DataFrame) -> pd.DataFrame:
        pool = rows.sort_values("pos").reset_index(drop=True)
        left, sources, order = list(range(len(pool))), pool["source"].tolist(), []
        while left:
            recent = {sources[i] for i in order[-window:]} if window > 0 else set()
            order.append(left.pop(next((n for n, i in enumerate(left) if sources[i] not in recent), 0)))
        out = pool.iloc[order].copy()
        out["pos"] = range(1, len(out) + 1)
        return out

    return results.groupBy("query_id").applyInPandas(weave, results.schema)


def contributions(results: DataFrame) -> DataFrame:
    """Per query and engine, the number of results it is credited with."""
    return results.select("query_id", F.explode("engines").alias("engine")).groupBy("query_id", "engine").agg(F.count(F.lit(1)).alias("n"))


def filter_domains(results: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = (), host: str = "host") -> DataFrame:
    """Results of the included hosts, if any are named, without the excluded ones, which win."""
    inside = [d.strip() for d in include if d and d.strip()]
    outside = [d.strip() for d in exclude if d and d.strip()]
    keep = F.lit(True)
    for names, wanted in ((inside, True), (outside, False)):
        if names:
            hit = F.lit(False)
            for d in names:
                hit = hit | url.host_matches(F.col(host), F.lit(d))
            keep = keep & (hit if wanted else ~hit)
    return results.filter(keep)


def rewrite_urls(rankings: DataFrame) -> DataFrame:
    """Redirect wrappers replaced by the targets inside them, where these can be decoded and are no wrappers; ``wrapper_url`` keeps the old one. Fuse afterwards."""
    parsed = url.with_url(rankings, "url", "_u").withColumn("_t", F.when(url.is_wrapper(F.col("url"), "_u"), url.wrapper_target(F.col("url"))))
    checked = url.with_url(url.bound(parsed, "_t"), "_t", "_tu")
    good = F.col("_t").isNotNull() & F.col("_tu").isNotNull() & ~url.is_wrapper(F.col("_t"), "_tu")
    return checked.withColumn("wrapper_url", F.when(good, F.col("url"))).withColumn("url", F.when(good, F.col("_t")).otherwise(F.col("url"))).drop("_u", "_t", "_tu")


def merge_lists(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two lists for each query (query_id, key, pos, title, snippet, published_at): those of the first, their gaps filled from the second, then the rest of the second."""
    a, b = first.alias("a"), second.alias("b")
    both = a.join(b, ["query_id", "key"], "full_outer")
    text_of = lambda c: F.when(F.coalesce(F.col(f"a.{c}"), F.lit("")) != "", F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    joined = both.select("query_id", "key", F.col("a.pos").isNull().alias("_late"), F.coalesce("a.pos", "b.pos").alias("_pos"), text_of("title"), text_of("snippet"), F.coalesce("a.published_at", "b.published_at").alias("published_at"))
    return joined.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("_late", "_pos"))).drop("_late", "_pos")


def fill_dates(results: DataFrame, dates: DataFrame) -> DataFrame:
    """Missing dates looked up by page key in ``dates`` (key, published_at)."""
    looked = dates.groupBy("key").agg(F.min("published_at").alias("_d"))
    return results.join(looked, "key", "left").withColumn("published_at", F.coalesce("published_at", "_d")).drop("_d")
