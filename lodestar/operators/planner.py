"""Planning which sources a query runs, tier by tier, and stopping when enough has been found.

A plan is a table (query_id, tier_ord, tier, engine, place). Tiers are run for all queries at once; a tier's results count for
a query only while the tiers before it found too few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.config import Config
from lodestar.functions import text
from lodestar.sources import registry

from . import fusion

def _listed(tier: str, order: int, ids: tuple[str, ...]) -> list[tuple]:
    return [(order, tier, e, i) for i, e in enumerate(ids)]


def plan(queries: DataFrame, config: Config | None = None, engines: tuple[str, ...] = (), every: bool = False) -> DataFrame:
    """The plan of each query (query_id, query[, region, language]). Named engines run alone, in the order given; ``all`` names every one."""
    c = config or Config()
    named = tuple(dict.fromkeys(e for e in engines if e and e != "auto"))
    if every or "all" in named:
        rows = _listed("all", 0, registry.IDS)
    elif named:
        rows = _listed("explicit", 0, named)
    elif not c.auto_engines:
        rows = _listed("configured", 0, c.engines)
    else:
        keyed = tuple(e[0] for e in registry.ENGINES if e[1] == "keyed" and registry.is_configured(e[0], c))[:2]
        api = tuple(e[0] for e in registry.ENGINES if e[4])
        rows = _listed("keyed", 0, keyed) + _listed("primary", 1, c.primary_engines) + _listed("fallback", 2, c.fallback_engines) + _listed("api", 3, api)
    if not rows:
        rows = [(0, "none", None, 0)]
    info = {e[0]: e for e in registry.ENGINES}
    # the table of tiers is a few rows, put into each query's row as an array
    steps = F.array(*[F.struct(F.lit(o).alias("tier_ord"), F.lit(t).alias("tier"), F.lit(e).alias("engine"), F.lit(i).alias("place"), F.lit(info[e][3] if e in info else None).cast("string").alias("affinity"), F.lit(info[e][4] if e in info and t == "api" else None).cast("string").alias("triggers")) for o, t, e, i in rows])
    q = F.trim("query")
    cjk = text.has_cjk(q)
    if "region" in queries.columns:
        cjk = cjk | F.coalesce(F.col("region") == "cn", F.lit(False))
    if "language" in queries.columns:
        cjk = cjk | F.coalesce(F.col("language") == "zh", F.lit(False))
    steps = F.filter(steps, lambda s: ~((s.tier == "fallback") & (s.affinity == "cn")) | cjk)
    steps = F.filter(steps, lambda s: s.triggers.isNull() | F.regexp_like(q, F.concat(F.lit("(?i)"), s.triggers)))
    known = F.filter(steps, lambda s: s.engine.isin(*registry.IDS))
    return queries.filter(q != "").select("query_id", F.explode(known).alias("s")).select("query_id", "s.tier_ord", "s.tier", "s.engine", "s.place")


def options(queries: DataFrame, config: Config | None = None) -> DataFrame:
    """``queries`` with language and region bound: the query's own option, or else the configured one; the language is guessed where neither names it."""
    c = config or Config()
    own = lambda name: F.when(F.trim(F.col(name)) != "", F.col(name)) if name in queries.columns else F.lit(None).cast("string")
    said = {"language": F.coalesce(own("language"), F.lit(c.language or None).cast("string"), text.guess_language(F.col("query"))), "region": F.coalesce(own("region"), F.lit(c.region or None).cast("string"))}
    return queries.withColumns(said)


def refusals(queries: DataFrame) -> DataFrame:
    """(query_id, engine, error) of the queries that aren't searched: those without a character."""
    return queries.filter(F.trim(F.coalesce("query", F.lit(""))) == "").select("query_id", F.lit("none").alias("engine"), F.lit("empty query").alias("error"))


def available(planned: DataFrame, config: Config | None = None, benched: DataFrame | None = None) -> DataFrame:
    """The plan with ``state``: usable, skipped (benched: a table of engine) or unconfigured."""
    c = config or Config()
    ready = [e for e in registry.IDS if registry.is_configured(e, c)]
    out = planned.withColumn("configured", F.col("engine").isin(ready))
    if benched is not None:
        out = out.join(benched.select("engine").distinct().withColumn("_b", F.lit(True)), "engine", "left")
    else:
        out = out.withColumn("_b", F.lit(None).cast("boolean"))
    state = F.when(~F.col("configured"), "unconfigured").when(F.coalesce("_b", F.lit(False)), "skipped").otherwise("usable")
    return out.withColumn("state", state).drop("_b", "configured")


def tier_prefix(planned: DataFrame, rankings: DataFrame, limit: int = 12, config: Config | None = None) -> DataFrame:
    """Rankings of the tiers that are run: a tier runs if the pages found by the tiers before it are fewer than wanted.

    ``rankings`` has the plan's engine; the pages found are distinct normalised addresses, at most twice the limit as in fusion."""
    c = config or Config()
    enough = max(limit, c.primary_min_results)
    rows = fusion.keyed(rankings.join(planned.select("query_id", "engine", "tier_ord"), ["query_id", "engine"]))
    first = rows.groupBy("query_id", F.col("u.key").alias("key")).agg(F.min("tier_ord").alias("tier_ord"))
    found = first.groupBy("query_id", "tier_ord").agg(F.count(F.lit(1)).alias("n"))
    tiers = planned.select("query_id", "tier_ord").distinct().join(found, ["query_id", "tier_ord"], "left")
    before = Window.partitionBy("query_id").orderBy("tier_ord").rowsBetween(Window.unboundedPreceding, -1)
    run = tiers.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.least(F.col("before"), F.lit(2 * limit)) < enough).select("query_id", "tier_ord")
    return rankings.join(planned.select("query_id", "engine", "tier_ord"), ["query_id", "engine"]).join(run, ["query_id", "tier_ord"], "left_semi")


def search(queries: DataFrame, rankings: DataFrame, limit: int = 12, config: Config | None = None, engines: tuple[str, ...] = (), include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), benched: DataFrame | None = None) -> DataFrame:
    """Fused results per query: plan, availability, tiers, sanitising, unwrapping, fusion of twice the limit, domain filters, limit."""
    c = config or Config()
    limit = max(1, min(limit, 100))
    planned = available(plan(options(queries, c), c, engines), c, benched).filter("state = 'usable'")
    weights = F.broadcast(registry.engines(queries.sparkSession).select("engine", F.col("weight").alias("_w"), F.col("engine_ord").alias("_o")))  # 24 rows
    rows = rankings.drop("weight", "engine_ord").join(weights, "engine").withColumnRenamed("_w", "weight").withColumnRenamed("_o", "engine_ord").filter(F.col("rank") <= max(3, min(c.per_engine, 30)))
    clean = fusion.sanitise(fusion.rewrite_urls(rows).drop("wrapper_url"))
    chosen = clean if engines else tier_prefix(planned, clean, limit, c).drop("tier_ord")
    if engines:
        chosen = clean.join(planned.select("query_id", "engine"), ["query_id", "engine"], "left_semi")
    fused = fusion.fused_results(chosen, 2 * limit, c)
    return fusion.limit_per_query(fusion.filter_domains(fused, include, exclude), limit)
