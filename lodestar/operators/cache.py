"""Durable tables of pages and responses: upsert, lookup with expiry, pruning, statistics.

A table is a DataFrame; writing operators return the table's new contents, to be written by the caller (or by a streaming batch function)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], by: list[Column]) -> DataFrame:
    """The newest row of each key. A key's rows meet in one aggregate state, not in one sort."""
    packed = F.struct(*[F.col(c) for c in rows.columns])
    best = rows.groupBy(*key).agg(F.max_by(packed, F.struct(*by)).alias("_row"))
    return best.select("_row.*")


def upsert(table: DataFrame, new: DataFrame, key: list[str], at: str) -> DataFrame:
    """``table`` with the rows of ``new`` in place of those of equal key; of several new rows the newest counts."""
    fresh = latest(new, key, [F.col(at)])
    return table.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def hits(table: DataFrame, ttl_s: int, now: Column, at: str = "fetched_at") -> DataFrame:
    """Rows that haven't expired; a negative time to live never expires."""
    return table if ttl_s < 0 else table.filter(F.unix_micros(now) - F.unix_micros(F.col(at)) <= ttl_s * 1_000_000)


def lookup(table: DataFrame, wanted: DataFrame, key: list[str], ttl_s: int, now: Column, at: str = "fetched_at") -> DataFrame:
    """``wanted`` left-joined with the rows that haven't expired, and whether there was one."""
    found = hits(table, ttl_s, now, at).withColumn("hit", F.lit(True))
    return wanted.join(found, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def prune(table: DataFrame, now: Column, max_age_s: int | None = None, max_rows: int | None = None, at: str = "fetched_at", tie: str = "url") -> DataFrame:
    """Rows not older than an age, and of these the newest so many.

    Each task keeps its newest ``max_rows`` at most, and those are merged: what one task holds is bounded by that parameter."""
    kept = table if max_age_s is None else table.filter(F.unix_micros(now) - F.unix_micros(F.col(at)) <= max_age_s * 1_000_000)
    return kept if max_rows is None else kept.orderBy(F.desc(at), F.asc(tie)).limit(max_rows)


def clear(table: DataFrame, scope: Column | None = None) -> tuple[DataFrame, int]:
    """The table without the rows of the scope (all if none is given), and how many these are."""
    gone = table.filter(scope) if scope is not None else table
    left = table.filter(~F.coalesce(scope, F.lit(False))) if scope is not None else table.limit(0)
    return left, gone.count()


def compact(table: DataFrame, partitions: int, by: str = "fetched_at") -> DataFrame:
    """Fewer, sorted files."""
    return table.repartitionByRange(partitions, by).sortWithinPartitions(by)


def stats(table: DataFrame, at: str = "fetched_at") -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("oldest"), F.max(at).alias("newest"))


def keep_newest(puts: DataFrame, most: int = 200, key: str = "url", seq: str = "seq") -> DataFrame:
    """What an insertion-ordered store of ``most`` entries holds after a sequence of puts."""
    last = puts.groupBy(key).agg(F.max(seq).alias(seq))
    return last.orderBy(F.desc(seq)).limit(most)


def count_terms(pages: DataFrame, queries: DataFrame, block: int = 2_000) -> DataFrame:
    """Plain search without an index: per query and page the number of its distinct terms (array ``terms``) that occur.

    Queries are a stated set: their terms are gathered on the executors into rows of at most about ``block``, and each page meets each row once, with
    what it holds of it as the only output."""
    hay = F.lower(F.concat_ws(" ", "title", "content"))
    terms = queries.select("query_id", F.explode("terms").alias("term")).distinct()
    of_term = terms.groupBy("term").agg(F.collect_list("query_id").alias("queries"))
    parts = max(1, -(-of_term.count() // block))
    wanted = of_term.groupBy(F.pmod(F.xxhash64("term"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("term", "queries")).alias("want")).select("want")
    found = pages.select("doc_id", hay.alias("hay")).join(wanted, F.exists("want", lambda x: F.contains(F.col("hay"), x.term)))
    hit = found.select("doc_id", F.explode(F.filter("want", lambda x: F.contains(F.col("hay"), x.term))).alias("x"))
    return hit.select("doc_id", F.explode("x.queries").alias("query_id")).groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("score"))


def page_row(payload: Column) -> Column:
    """A stored page's JSON payload as a struct."""
    return F.from_json(payload, "byline string, publishedAt string, excerpt string, language string, siteName string, links array<struct<text:string,url:string>>, document struct<kind:string,pages:int,chars:long>, warnings array<string>")
