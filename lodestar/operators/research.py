"""Research: query expansion, merging of several queries' results, choice of sources, and the brief's passages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text

from . import passages

# Hosts without prose (matched at a host's boundary) and endings of binary files.
NON_PROSE = r"(?i)^https?://(?:[^/]*\.)?(?:youtube\.com|youtu\.be|vimeo\.com|instagram\.com|facebook\.com|tiktok\.com|twitter\.com|x\.com|pinterest\.[a-z.]+|play\.google\.com|apps\.apple\.com)(?:[:/?#]|$)"
BINARY = r"(?i)\.(?:zip|gz|tgz|rar|7z|exe|msi|dmg|iso|apk|mp4|mp3|avi|mov|wav|torrent|woff2?|ttf|eot)$"


def expansion_terms(queries: DataFrame, results: DataFrame, scanned: int = 12) -> DataFrame:
    """(query_id, term, shown, df, place): terms of several of a query's first results that the query lacks, most frequent first.

    ``results`` has query_id, pos, title, snippet."""
    top = results.filter(F.col("pos") <= scanned).withColumn("said", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))))
    total = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_results"))
    own = queries.select("query_id", text.unique_terms(F.col("query")).alias("own"))
    terms = top.join(own, "query_id").select("query_id", "pos", "said", F.explode(F.array_except(F.array_distinct(text.tokens(F.col("said"))), F.col("own"))).alias("term"))
    usable = ((F.length("term") >= 3) | F.col("term").rlike("[㐀-鿿]")) & ~F.col("term").rlike("^[0-9]+$")
    shown = F.regexp_substr("said", F.concat(F.lit(r"(?i)\b\Q"), F.col("term"), F.lit(r"\E\b")))
    counted = terms.filter(usable).groupBy("query_id", "term").agg(F.countDistinct("pos").alias("df"), F.min_by(F.struct(F.col("said"), F.col("term")), "pos").alias("f"))
    named = counted.withColumn("said", F.col("f.said")).withColumn("shown", F.coalesce(shown, F.col("term"))).drop("said", "f")
    limit = F.greatest(F.lit(3), F.ceil(F.col("n_results") * 0.8))
    kept = named.join(total, "query_id").filter((F.col("df") >= 2) & (F.col("df") <= limit))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("df"), "term"))
    return kept.select("query_id", "term", "shown", "df", place.alias("place"))


def expand_queries(queries: DataFrame, results: DataFrame, count: int = 2) -> DataFrame:
    """(query_id, n, query): the query with the first term, and with the second and third (or the second alone)."""
    top = expansion_terms(queries, results).filter("place <= 3").groupBy("query_id").pivot("place", [1, 2, 3]).agg(F.first("shown"))
    named = queries.select("query_id", "query").join(top, "query_id")
    said = F.array(F.concat_ws(" ", "query", F.col("`1`")), F.when(F.col("`2`").isNotNull(), F.concat_ws(" ", "query", F.col("`2`"), F.col("`3`"))))
    return named.select("query_id", F.posexplode(F.slice(F.filter(said, lambda x: x.isNotNull()), 1, count)).alias("n", "expanded")).select("query_id", "n", F.col("expanded").alias("query"))


def absorb(results: DataFrame) -> DataFrame:
    """Results of several searches for one question (query_id, search_ord, pos, url, ...) merged by page: best score, all engines, longest snippet, first date; the rest from the first."""
    rows = results.withColumn("seq", F.col("search_ord").cast("long") * 1_000_000 + F.col("pos"))
    merged = rows.groupBy("query_id", "url").agg(
        F.max("score").alias("score"),
        F.array_sort(F.collect_list(F.struct("seq", "engines"))).alias("_e"),
        F.max_by("snippet", F.struct(F.length("snippet"), -F.col("seq"))).alias("snippet"),
        F.min_by("published_at", F.when(F.col("published_at").isNotNull(), F.col("seq"))).alias("published_at"),
        F.min_by(F.struct("title", "source", "best_rank"), "seq").alias("_f"),
        F.min("seq").alias("seq"),
    )
    return merged.select("query_id", "url", "score", F.array_distinct(F.flatten(F.transform("_e", lambda x: x.engines))).alias("engines"), "snippet", "published_at", "_f.title", "_f.source", "_f.best_rank", "seq")


def choose_sources(results: DataFrame, most: int) -> DataFrame:
    """The pages to read: prose only, by score and agreement, one of each domain (two if there are eight or more), filled up beyond that. ``pos`` is their order."""
    per_domain = 2 if most >= 8 else 1
    value = F.col("score") + (F.size("engines") - 1) * 0.05
    kept = results.filter(~F.col("url").rlike(NON_PROSE) & ~F.col("url").rlike(BINARY)).withColumn("_v", value)
    within = F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("_v"), "seq"))
    ranked = kept.withColumn("_over", (within > per_domain).cast("int"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_over", F.desc("_v"), "seq"))
    return ranked.withColumn("pos", place).filter(F.col("pos") <= most).drop("_v", "_over")


def brief_passages(sources: DataFrame, pages: DataFrame, queries: DataFrame, per_source: int = 4, total: int = 60_000) -> DataFrame:
    """(query_id, pos, url, passages): passages of each chosen source under a budget of characters that runs through a query's sources in order.

    ``pages`` has url and content. Each source may use what is left, between 600 and 2600 characters; when nothing is left the rest goes without."""
    terms = queries.select("query_id", text.unique_terms(F.col("query")).alias("terms"))
    rows = sources.select("query_id", "pos", "url").join(pages.select("url", "content"), "url").join(terms, "query_id")
    numbered = rows.withColumn("doc_id", F.col("pos"))
    chosen = passages.select_passages(numbered.select("doc_id", "query_id", "content", "terms"), most=per_source, total_chars=2600)
    joined = numbered.select("query_id", "pos", "url").join(chosen.withColumnRenamed("doc_id", "pos"), ["query_id", "pos"])

    def spend(group: pd.DataFrame) -> pd.DataFrame:
        group, used, out = group.sort_values("pos"), 0, []
        for found in group["passages"]:
            left, kept = total - used, []
            budget = min(max(left, 600), 2600)
            # within a source the best passages come first when the budget is short
            for p in sorted(found, key=lambda p: -p["score"]) if left > 0 else ():
                if sum(len(k["text"]) for k in kept) >= budget:
                    break
                kept.append(p)
            used += sum(len(k["text"]) for k in kept)
            out.append(sorted(kept, key=lambda p: p["offset"]))
        return group.assign(passages=out)

    return joined.groupBy("query_id").applyInPandas(spend, joined.schema)


def research(queries: DataFrame, search, pages: DataFrame, depth: int = 2, max_sources: int = 8, per_source: int = 4) -> DataFrame:
    """One row per question and source, with its passages.

    ``search`` gets (query_id, root, query), where ``root`` is the question that a query stems from, and returns results with pos per query_id."""
    depth, max_sources = max(1, min(depth, 3)), max(1, min(max_sources, 15))
    first = search(queries.select("query_id", F.col("query_id").alias("root"), "query")).withColumn("search_ord", F.lit(0))
    every = first
    if depth >= 2:
        more = expand_queries(queries, first, 2 if depth == 2 else 3)
        # follow-up queries are numbered anew; they are searched on their own
        asked = more.select((F.col("query_id") * 4 + F.col("n")).alias("query_id"), F.col("query_id").alias("root"), "n", "query")
        again = search(asked.select("query_id", "root", "query")).join(asked.select("query_id", "root", "n"), "query_id").withColumn("search_ord", F.col("n") + 1).withColumn("query_id", F.col("root")).drop("root", "n")
        every = first.unionByName(again.select(*first.columns))
    sources = choose_sources(absorb(every), max_sources)
    found = brief_passages(sources, pages, queries, per_source)
    return sources.join(found.select("query_id", "pos", "passages"), ["query_id", "pos"], "left")
