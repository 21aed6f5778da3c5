"""Circuit breaker per source, as a fold over its attempts: batch, as of a time, and as a stream with keyed state.

An attempt is (engine, ts, ok, results, latency_ms, error). A success clears the count of failures and the bench. A failure adds to it;
a block benches at once, an unreachable host at once but for a shorter time, anything else after ``threshold`` failures in a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.config import Config
from lodestar.functions.policy import failure_kind

STATE = "consecutive_failures long, benched_until_us long, total_calls long, total_failures long, total_results long, last_error string, last_latency_ms double, last_us long"


def policies(attempts: DataFrame, config: Config | None = None) -> DataFrame:
    """Attempts with the kind of failure, and how many failures and microseconds its bench takes."""
    c = config or Config()
    kind = F.when(~F.col("ok"), failure_kind(F.coalesce("error", F.lit(""))))
    short = min(c.cooldown_ms, c.unreachable_ms)
    return attempts.withColumn("kind", kind).withColumn("need", F.when(kind == "other", max(1, c.failure_threshold)).otherwise(1)).withColumn("bench_us", F.when(kind == "unreachable", short).otherwise(c.cooldown_ms).cast("long") * 1000)


def state(attempts: DataFrame, config: Config | None = None) -> DataFrame:
    """The breaker's state per engine after all its attempts.

    Failures in a row are gaps and islands: successes split the attempts, and what counts is the last island. So a hot engine is
    a matter of aggregates, not of one sorted list."""
    rows = policies(attempts, config).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    last_ok = rows.groupBy("engine").agg(F.max(F.when(F.col("ok"), F.struct("us", "seq"))).alias("last_ok"))
    failed = rows.filter("not ok").join(last_ok, "engine").filter(F.col("last_ok").isNull() | (F.struct("us", "seq") > F.col("last_ok")))
    run = failed.groupBy("engine").agg(F.count(F.lit(1)).alias("consecutive_failures"), F.sum((F.col("kind") != "other").cast("long")).alias("_any"))
    # the bench is set by the last failure that reaches its policy's count; for a block or an unreachable host that is each one,
    # for others each one from the threshold on, so only the number of failures before it matters
    need = max(1, (config or Config()).failure_threshold)
    first = failed.filter("kind = 'other'").groupBy("engine").agg(F.max(F.struct("us", "seq", "bench_us")).alias("o"))
    early = failed.filter("kind <> 'other'").groupBy("engine").agg(F.max(F.struct("us", "seq", "bench_us")).alias("e"))
    benched = run.join(first, "engine", "left").join(early, "engine", "left")
    use_other = F.col("o").isNotNull() & (F.col("consecutive_failures") >= need) & (F.col("e").isNull() | (F.col("o") > F.col("e")))
    # an 'other' failure sets the bench at its own time if at least `need` failures came up to it; the last one has them all
    chosen = F.when(use_other & (F.col("rank_ok")), F.col("o")).otherwise(F.col("e"))
    late = failed.join(benched.select("engine", F.col("o").alias("_o")), "engine").filter(F.struct("us", "seq") <= F.struct(F.col("_o.us").alias("us"), F.col("_o.seq").alias("seq"))).groupBy("engine").agg((F.count(F.lit(1)) >= need).alias("rank_ok"))
    benched = benched.join(late, "engine", "left").withColumn("rank_ok", F.coalesce("rank_ok", F.lit(False)))
    until = benched.select("engine", "consecutive_failures", F.coalesce(chosen["us"] + chosen["bench_us"], F.lit(0)).alias("benched_until_us"))
    totals = rows.groupBy("engine").agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.sum((~F.col("ok")).cast("long")).alias("total_failures"),
        F.sum(F.when(F.col("ok"), F.col("results")).otherwise(0)).alias("total_results"),
        F.max_by("error", F.when(~F.col("ok"), F.struct("us", "seq"))).alias("_error"),
        F.max(F.when(~F.col("ok"), F.struct("us", "seq"))).alias("_failed"),
        F.max(F.when(F.col("ok"), F.struct("us", "seq"))).alias("_good"),
        F.max_by("latency_ms", F.when(F.col("latency_ms").isNotNull(), F.struct("us", "seq"))).alias("last_latency_ms"),
        F.max("us").alias("last_us"),
    )
    out = totals.join(until, "engine", "left")
    error = F.when(F.col("_good").isNull() | (F.col("_failed") > F.col("_good")), F.col("_error"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("engine", zero("consecutive_failures"), zero("benched_until_us"), "total_calls", "total_failures", zero("total_results"), error.alias("last_error"), "last_latency_ms", "last_us")


def recovered(states: DataFrame, now: Column) -> DataFrame:
    """States after a restart: expired benches are lifted and their counts reset; totals and errors stay."""
    gone = F.col("benched_until_us") <= F.unix_micros(now)
    return states.withColumn("consecutive_failures", F.when(gone, F.lit(0)).otherwise(F.col("consecutive_failures"))).withColumn("benched_until_us", F.when(gone, F.lit(0)).otherwise(F.col("benched_until_us")))


def snapshot(engines: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """Health of every known engine as of ``now``; one never tried is fine."""
    benched = F.coalesce(F.col("benched_until_us") > F.unix_micros(now), F.lit(False))
    rows = engines.select("engine").join(states, "engine", "left")
    return rows.select(
        "engine",
        (F.coalesce(F.col("consecutive_failures") == 0, F.lit(True)) & ~benched).alias("ok"),
        F.coalesce("last_latency_ms", F.lit(0.0)).alias("latency_ms"),
        F.coalesce("total_results", F.lit(0)).alias("results"),
        F.col("last_error").alias("error"),
        benched.alias("skipped"),
        F.greatest(F.lit(0), F.coalesce("benched_until_us", F.lit(0)) - F.unix_micros(now)).alias("benched_remaining_us"),
    )


def sweep(engines: DataFrame, attempts: DataFrame) -> DataFrame:
    """What a round of probes found, per engine: outcome (ok, empty, failed with its kind, or untried), results and latency."""
    one = policies(attempts).groupBy("engine").agg(F.max_by(F.struct("ok", "results", "latency_ms", "error", "kind"), F.struct("ts", "seq")).alias("a"))
    outcome = F.when(F.col("a").isNull(), "untried").when(~F.col("a.ok"), F.col("a.kind")).when(F.coalesce("a.results", F.lit(0)) == 0, "empty").otherwise("ok")
    return engines.select("engine").join(one, "engine", "left").select("engine", outcome.alias("outcome"), "a.results", "a.latency_ms", "a.error")


def usable(swept: DataFrame) -> DataFrame:
    """One row: how many engines can be used, of how many tried."""
    return swept.agg(F.count_if(F.col("outcome") == "ok").alias("usable"), F.count_if(F.col("outcome") != "untried").alias("tried"))


def benched_engines(states: DataFrame, now: Column) -> DataFrame:
    return states.filter(F.col("benched_until_us") > F.unix_micros(now)).select("engine")


def advance(held: tuple, attempts: pd.DataFrame) -> tuple:
    """The state of one engine after some attempts in order; columns ok, results, latency_ms, error, need, bench_us, us."""
    failures, until, calls, failed, results, error, latency, last = held
    for a in attempts.itertuples(index=False):
        calls += 1
        last = max(last, int(a.us))
        if a.latency_ms == a.latency_ms and a.latency_ms is not None:
            latency = float(a.latency_ms)
        if a.ok:
            failures, until, error = 0, 0, None
            results += int(a.results)
        else:
            failures += 1
            failed += 1
            error = a.error
            if failures >= a.need:
                until = int(a.us) + int(a.bench_us)
    return failures, until, calls, failed, results, error, latency, last


EMPTY = (0, 0, 0, 0, 0, None, None, 0)


def stream(attempts: DataFrame, config: Config | None = None) -> DataFrame:
    """The same as a stream: one row per engine and batch with its state so far, kept in the state store."""
    rows = policies(attempts, config).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))

    def fold(key: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(parts)).sort_values(["us", "seq"])
        now = advance(held.get if held.exists else EMPTY, new)
        held.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=["engine", *[f.split()[0] for f in STATE.split(", ")]])

    return rows.groupBy("engine").applyInPandasWithState(fold, f"engine string, {STATE}", STATE, "update", "NoTimeout")


def replay(attempts: DataFrame, config: Config | None = None) -> DataFrame:
    """The plain fold, engine by engine: what ``state`` is held against in tests."""
    rows = policies(attempts, config).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["us", "seq"])
        return pd.DataFrame([(group["engine"].iloc[0], *advance(EMPTY, group))], columns=["engine", *[f.split()[0] for f in STATE.split(", ")]])

    return rows.groupBy("engine").applyInPandas(fold, f"engine string, {STATE}")


def first_responses(responses: DataFrame, ttl: str = "15 minutes") -> DataFrame:
    """A stream of responses (cache_key, ts, ...) without those whose key came within the time to live."""
    return responses.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["cache_key"])


def failures_in_a_row(attempts: DataFrame) -> DataFrame:
    """Each attempt with the number of failures in a row up to it, by gaps and islands; the window is per engine."""
    order = Window.partitionBy("engine").orderBy("ts", "seq")
    island = F.sum(F.col("ok").cast("int")).over(order)
    rows = attempts.withColumn("island", island)
    return rows.withColumn("failures", F.sum((~F.col("ok")).cast("long")).over(Window.partitionBy("engine", "island").orderBy("ts", "seq"))).drop("island")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a table's finished versions, in order."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [x.getPath() for x in files.listStatus(folder)]
    done = [x.getName()[1:] for x in names if x.getName()[:1] == "v" and files.exists(x.suffix("/_SUCCESS"))]
    return sorted(int(n) for n in done if n.isdigit())


def read_sink(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The newest finished version of an upsert sink's table."""
    found = _versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v{found[-1]}") if found else spark.createDataFrame([], schema)


def upsert_sink(path: str, key: list[str], at: str):
    """A ``foreachBatch`` function that keeps the newest row of each key in a Parquet table; every batch makes a version, of which the last two stay.

    The table goes on from its newest finished version, whatever the numbers of the batches, so a stream may start anew
    or repeat a batch. A version is the whole table: this is for states of few keys."""
    from lodestar.operators import cache

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        found = _versions(spark, path)
        table = spark.read.schema(batch.schema).parquet(f"{path}/v{found[-1]}") if found else batch.limit(0)
        cache.upsert(table, batch, key, at).write.mode("overwrite").parquet(f"{path}/v{found[-1] + 1 if found else 0}")
        for old in found[:-1]:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{old}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    return put
