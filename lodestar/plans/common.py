"""Tables and derived inputs shared by the queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def title_of(html: str = "html"):
    return F.trim(F.regexp_extract(F.col(html), r"(?s)<title>(.*?)</title>", 1))


#: Pages that one query finds; the queries grow with the table.
PER_QUERY = 25


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ranked lists for each query, made from all pages, ``PER_QUERY`` to a query: by number, by length and by address."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(f"page_id div {PER_QUERY}").alias("query_id"), F.length("html").alias("n"), title_of().alias("title"))
    orders = {"a": (0, 1.0, ["page_id"]), "b": (1, 0.9, [F.desc("n"), "page_id"]), "c": (2, 0.8, ["url", "page_id"])}
    lists = []
    for engine, (place, weight, order) in orders.items():
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
        lists.append(pages.select("query_id", F.lit(engine).alias("engine"), F.lit(place).alias("engine_ord"), F.lit(weight).alias("weight"), rank.alias("rank"), "title", "url", F.concat(F.lit(f"{engine}: "), F.col("title")).alias("snippet"), F.timestamp_seconds(F.col("page_id") * 3600 + 1_700_000_000).alias("published_at")))
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


# --- the same in SQL -------------------------------------------------------------------------------------------------

TITLE = "trim(regexp_extract(html, '<title>(.*?)</title>', 1, 's'))"


def key_sql(column: str) -> str:
    """The normalised address of plain ASCII web addresses, as the pages have."""
    from lodestar.functions.url import KEEP, TRACKING

    names = ", ".join(f"'{x}'" for x in TRACKING)
    keep = ", ".join(f"'{x}'" for x in KEEP)
    base = f"regexp_replace({column}, '#.*$', '')"
    host = f"regexp_replace(lower(regexp_extract({base}, '^[a-zA-Z]+://([^/?]*)', 1)), '^www\\.', '')"
    path = f"regexp_replace(regexp_replace(regexp_extract({base}, '^[a-zA-Z]+://[^/?]*([^?]*)', 1), '/index\\.(html?|php|aspx?)$', '/', 'i'), '/+$', '')"
    params = f"list_filter(string_split(regexp_extract({base}, '\\?(.*)$', 1), '&'), lambda x: x <> '' and (string_split(x, '=')[1] in ({keep}) or (regexp_matches(x, '=.') and not lower(string_split(x, '=')[1]) in ({names}))))"
    return f"lower(regexp_extract({base}, '^([a-zA-Z]+)://', 1)) || '://' || {host} || case when {path} = '' then '/' else {path} end || case when len({params}) > 0 then '?' || array_to_string(list_sort({params}), '&') else '' end"


def host_sql(column: str) -> str:
    return f"regexp_replace(lower(regexp_extract({column}, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '')"


def domain_sql(column: str) -> str:
    """The last two labels; no host of the pages is below a longer suffix."""
    return f"regexp_extract({host_sql(column)}, '([^.]+\\.[^.]+)$', 1)"


def rankings_sql() -> str:
    base = f"select page_id, url, page_id // {PER_QUERY} as query_id, length(html) as n, {TITLE} as title from pages"
    one = lambda e, i, w, order: f"select query_id, '{e}' as engine, {i} as engine_ord, {w}::double as weight, row_number() over (partition by query_id order by {order}) as rank, title, url, '{e}: ' || title as snippet, page_id * 3600 + 1700000000 as published from p"
    lists = " union all ".join((one("a", 0, 1.0, "page_id"), one("b", 1, 0.9, "n desc, page_id"), one("c", 2, 0.8, "url, page_id")))
    return f"p as ({base}), raw as (select *, {key_sql('url')} as key, {host_sql('url')} as host, {domain_sql('url')} as domain from ({lists})), r as (select * from (select *, row_number() over (partition by query_id, engine, key order by rank) as n from raw) where n = 1)"


def fused_sql(bonus: float = 0.12, factor: str = "1") -> str:
    """Fusion over ``rankings_sql``: adds the table ``f``."""
    return rankings_sql() + f""", s as (select *, engine_ord * 1000000 + rank as seq, weight / (60.0 + rank) as part from r),
f as (select query_id, key as url, coalesce(nullif(arg_max(trim(title), length(title) * 100000000 - seq), ''), '/') as title, arg_max(trim(snippet), length(snippet) * 100000000 - seq) as snippet, any_value(domain) as source, any_value(host) as host,
  list(engine order by part desc, seq) as engine_list, min(rank)::int as best_rank, round((sum(part) + case when count(distinct engine) > 1 then {bonus} * (count(distinct engine) - 1) else 0 end) * {factor}, 6) as score, arg_min(published, seq) as published, min(seq) as seq
  from s group by query_id, key)"""
