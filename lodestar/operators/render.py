"""Results as Markdown or JSON, one row per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import dates, text, url


def _joined(rows: DataFrame, by: str, order: str, line: Column, sep: str) -> DataFrame:
    """The lines of each group in order, as one text."""
    packed = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("_l"))
    return packed.select(by, F.array_join(F.transform("_l", lambda x: x.l), sep).alias("body"), F.size("_l").alias("n"))


def search_results(queries: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """(query_id, markdown): a numbered list with source, engines, date and snippet. Queries without results say so."""
    about = F.filter(F.array(F.col("source"), F.array_join("engines", ", "), F.when(F.col("published_at").isNotNull(), dates.display(F.col("published_at"), now))), lambda x: F.coalesce(x, F.lit("")) != "")
    line = F.concat(F.col("pos").cast("string"), F.lit(". ["), text.md_link_text(F.col("title")), F.lit("]("), F.col("url"), F.lit(")\n   _"), F.array_join(about, " · "), F.lit("_"), F.when(F.coalesce("snippet", F.lit("")) != "", F.concat(F.lit("\n   "), F.regexp_replace("snippet", r"\s+", " "))).otherwise(F.lit("")))
    joined = queries.select("query_id", "query").join(_joined(results, "query_id", "pos", line, "\n\n"), "query_id", "left")
    head = F.concat(F.lit('# Results for "'), F.col("query"), F.lit('"\n\n'))
    return joined.select("query_id", F.concat(head, F.coalesce("body", F.lit("_No results._"))).alias("markdown"))


def search_json(results: DataFrame) -> DataFrame:
    """(query_id, json): the results without their empty fields."""
    one = F.struct("pos", "title", "url", F.nullif(F.col("snippet"), F.lit("")).alias("snippet"), "source", "engines", F.col("best_rank").alias("bestRank"), "score", dates.iso(F.col("published_at")).alias("publishedAt"))
    packed = results.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("results"))
    return packed.select("query_id", F.to_json(F.struct(F.size("results").alias("count"), "results")).alias("json"))


def fetched_page(pages: DataFrame, now: Column, include_links: bool = False) -> DataFrame:
    """(url, markdown): heading, source lines and content of converted pages (url, page struct, word_count)."""
    p = lambda c: F.col(f"page.{c}")
    facts = F.filter(F.array(url.display_host(F.col("url")), F.when(F.coalesce(p("byline"), F.lit("")) != "", F.concat(F.lit("by "), p("byline"))), p("published_at"), F.concat(F.format_number("word_count", 0), F.lit(" words"))), lambda x: F.coalesce(x, F.lit("")) != "")
    links = F.array_join(F.transform(p("links"), lambda x: F.concat(F.lit("- ["), text.md_link_text(x["text"]), F.lit("]("), x.url, F.lit(")"))), "\n")
    tail = F.when(F.lit(include_links) & (F.size(p("links")) > 0), F.concat(F.lit("\n\n## Links\n\n"), links)).otherwise(F.lit(""))
    return pages.select("url", F.concat(F.lit("# "), p("title"), F.lit("\n\n_"), F.array_join(facts, " · "), F.lit("_\n\n"), text.strip_leading_title(p("markdown"), p("title")), tail).alias("markdown"))


def fetched_batch(fetched: DataFrame) -> DataFrame:
    """One row: how many of the pages (url, error) were asked for, came and failed."""
    return fetched.agg(F.count(F.lit(1)).alias("requested"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def page_json(pages: DataFrame) -> DataFrame:
    return pages.select("url", F.to_json(F.struct("url", "page.*", F.col("word_count").alias("wordCount"))).alias("json"))


def research_brief(queries: DataFrame, found: DataFrame, most: int = 60_000) -> DataFrame:
    """(query_id, markdown): numbered sources, each with its quoted passages."""
    quoted = F.array_join(F.transform(F.coalesce("passages", F.array().cast("array<struct<offset:int,text:string,score:double>>")), lambda x: F.concat(F.lit("> "), F.replace(x["text"], F.lit("\n"), F.lit("\n> ")))), "\n\n")
    line = F.concat(F.lit("## ["), F.col("pos").cast("string"), F.lit("] "), text.md_link_text(F.col("title")), F.lit("\n"), F.col("url"), F.when(quoted != "", F.concat(F.lit("\n\n"), quoted)).otherwise(F.lit("\n\n_No passage could be read._")))
    joined = queries.select("query_id", "query").join(_joined(found, "query_id", "pos", line, "\n\n"), "query_id", "left")
    body = F.concat(F.lit("# Research: "), "query", F.lit("\n\n"), F.coalesce(F.concat(F.col("n").cast("string"), F.lit(" sources\n\n"), "body"), F.lit("_No sources._")))
    return joined.select("query_id", text.truncate(body, most).alias("markdown"))


def research_json(found: DataFrame) -> DataFrame:
    packed = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "url", "title", "score", "passages"))).alias("sources"))
    return packed.select("query_id", F.to_json(F.struct("sources")).alias("json"))


def _table(rows: DataFrame, order: str, head: list[str], cells: list[Column]) -> DataFrame:
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[text.md_cell(F.coalesce(c.cast("string"), F.lit(""))) for c in cells]), F.lit(" |"))
    packed = _joined(rows.withColumn("_g", F.lit(1)), "_g", order, line, "\n")
    return packed.select(F.concat(F.lit("| " + " | ".join(head) + " |\n| " + " | ".join(["---"] * len(head)) + " |\n"), "body").alias("markdown"))


def engine_table(engines: DataFrame, health: DataFrame) -> DataFrame:
    """One row with the table of the 24 engines and their health."""
    state = F.when(~F.col("configured"), "not configured").when(F.col("skipped"), "benched").when(F.coalesce("ok", F.lit(True)), "ok").otherwise("failing")
    rows = engines.join(health.select("engine", "ok", "skipped", "latency_ms", "error"), "engine", "left").withColumn("skipped", F.coalesce("skipped", F.lit(False)))
    return _table(rows, "engine_ord", ["engine", "tier", "weight", "state", "latency", "last error"], [F.col("engine"), F.col("tier"), F.col("weight"), state, F.when(F.col("latency_ms") > 0, F.concat(F.round("latency_ms").cast("long").cast("string"), F.lit(" ms"))), F.col("error")])


def cache_stats(stats: DataFrame, now: Column) -> DataFrame:
    return stats.select(F.concat(F.lit("Pages: "), F.format_number("n", 0), F.coalesce(F.concat(F.lit(" · oldest "), dates.display(F.col("oldest"), now), F.lit(" · newest "), dates.display(F.col("newest"), now)), F.lit(""))).alias("markdown"))


def index_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, markdown) of local search hits (pos, title, url, snippet, score)."""
    line = F.concat(F.col("pos").cast("string"), F.lit(". ["), text.md_link_text(F.col("title")), F.lit("]("), F.col("url"), F.lit(")\n   "), F.regexp_replace(F.coalesce("snippet", F.lit("")), r"\s+", " "))
    joined = queries.select("query_id", "query").join(_joined(hits, "query_id", "pos", line, "\n\n"), "query_id", "left")
    return joined.select("query_id", F.coalesce("body", F.lit("_Nothing in the index matches._")).alias("markdown"))
