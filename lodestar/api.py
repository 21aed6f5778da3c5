"""The engine's eight operations as methods on tables of questions, addresses and files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.config import Config
from lodestar.functions import policy, text, url
from lodestar.operators import cache, fusion, html, index, office, planner, render, research
from lodestar.session import configure
from lodestar.sources import registry

#: Name, arguments with their ranges, and what each operation does.
OPERATIONS = (
    ("web_search", "queries, rankings, max_results 1-50, engines, include, exclude", "fused results of many ranked lists"),
    ("research", "queries, rankings, pages, depth 1-3, max_sources 1-15, passages_per_source 1-8", "sources and passages that answer questions"),
    ("fetch_url", "pages, max_chars 500-400000, offset >= 0", "pages as Markdown"),
    ("fetch_urls", "pages, max_chars", "pages as Markdown with an error per row"),
    ("parse_document", "files, max_chars, sheet", "documents as Markdown"),
    ("search_index", "queries, max_results 1-50", "full-text search of stored pages"),
    ("local_index", "action stats|clear|prune|vacuum, max_age_s, max_rows", "upkeep of stored pages"),
    ("list_engines", "health", "sources with their state"),
)


def _between(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))


class Engine:
    def __init__(self, spark: SparkSession, config: Config | None = None, now: Column | None = None):
        self.spark, self.config, self.now = configure(spark), config or Config(), now if now is not None else F.current_timestamp()

    def web_search(self, queries: DataFrame, rankings: DataFrame, max_results: int = 12, **options: object) -> DataFrame:
        return planner.search(queries, rankings, _between(max_results, 1, 50), self.config, **options)

    def refused(self, queries: DataFrame) -> DataFrame:
        """The queries that ``web_search`` leaves out, with the reason."""
        return planner.refusals(queries)

    def research(self, queries: DataFrame, rankings: DataFrame, pages: DataFrame, depth: int = 2, max_sources: int = 8, passages_per_source: int = 4, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
        """``pages`` has url (normalised) and content. Rankings of follow-up questions are those of the question they come from."""

        def search(asked: DataFrame) -> DataFrame:
            lists = asked.select("query_id", "root").join(rankings.withColumnRenamed("query_id", "root"), "root").drop("root")
            return planner.search(asked, lists, max(10, 2 * max_sources), self.config, include=include, exclude=exclude)

        return research.research(queries, search, pages, depth, _between(max_sources, 1, 15), _between(passages_per_source, 1, 8))

    def fetch_urls(self, pages: DataFrame, robots: DataFrame | None = None, max_chars: int = 120_000, offset: int = 0) -> DataFrame:
        """``pages`` (url, html[, status]) as Markdown, sliced; ``robots`` (host, rules) is honoured. A page that may not or can't be read has an error instead."""
        max_chars = _between(max_chars, 500, 400_000)
        parsed = url.with_url(pages, "url", "u")
        error = F.when(F.col("u").isNull(), F.lit("not a web address")).otherwise(url.fetch_refusal(F.col("url"), self.config.allow_private_hosts))
        if "status" in pages.columns:
            error = F.coalesce(error, policy.block_reason(F.col("status"), F.col("html")))
        if robots is not None and self.config.respect_robots:
            parsed = parsed.withColumn("host", F.col("u.host")).join(robots.select("host", "rules"), "host", "left")
            error = F.coalesce(error, F.when(F.col("rules").isNotNull() & ~policy.path_allowed(F.col("rules"), F.col("u.path")), F.lit("disallowed by robots.txt")))
        judged = parsed.withColumn("error", error)
        done = html.pages_to_markdown(judged.withColumn("html", F.when(F.col("error").isNull(), F.col("html"))))
        body = F.col("page.markdown")
        sliced = done.withColumn("slice", text.sliced(body, offset, max_chars))
        content = F.col("slice.part")
        return sliced.select("url", F.when(F.col("error").isNull(), F.col("page.title")).alias("title"), F.when(F.col("error").isNull(), content).alias("content"), "slice.truncated", "slice.next_offset", text.count_words(content).alias("word_count"), "error", "page")

    fetch_url = fetch_urls

    def parse_document(self, files: DataFrame, max_chars: int = 120_000, sheet: str | None = None, **names: str) -> DataFrame:
        # one sheet may begin anywhere, so the cut comes after it is chosen
        out = office.parse_documents(files, max_chars=(1 << 31) - 1 if sheet else max_chars, **names)
        body = office.one_sheet(F.col("document.markdown"), sheet) if sheet else F.col("document.markdown")
        return out.withColumn("markdown", F.substr(body, F.lit(1), F.lit(max_chars)))

    def build_index(self, pages: DataFrame) -> index.Index:
        return index.build(pages)

    def search_index(self, built: index.Index, queries: DataFrame, pages: DataFrame, max_results: int = 10) -> DataFrame:
        top = index.search(built, queries, _between(max_results, 1, 50))
        return index.highlight(top.join(pages, "doc_id").join(queries, "query_id"))

    def local_index(self, pages: DataFrame, action: str = "stats", max_age_s: int | None = None, max_rows: int | None = None, partitions: int = 8) -> DataFrame:
        do: dict[str, Callable[[], DataFrame]] = {
            "stats": lambda: cache.stats(pages),
            "clear": lambda: cache.clear(pages)[0],
            "prune": lambda: cache.prune(pages, self.now, max_age_s, max_rows),
            "vacuum": lambda: cache.compact(pages, partitions),
        }
        if action not in do:
            raise ValueError(f"no such action: {action}")
        return do[action]()

    def list_engines(self, health: DataFrame | None = None) -> DataFrame:
        known = registry.catalogue(self.spark, self.config)
        return known if health is None else render.engine_table(known, health)

    def manifest(self) -> DataFrame:
        return self.spark.createDataFrame(list(OPERATIONS), "operation string, arguments string, purpose string")

    def fuse(self, rankings: DataFrame, limit: int = 12) -> DataFrame:
        return fusion.fused_results(rankings, limit, self.config)
