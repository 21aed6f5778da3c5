"""The table of result sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.config import Config

# Id, tier, weight, affinity, and the subjects that call for the source.
ENGINES = (
    ("duckduckgo", "primary", 1.0, "global", None),
    ("mojeek", "primary", 0.95, "global", None),
    ("googlenews", "primary", 0.9, "news", None),
    ("bing", "fallback", 1.0, "global", None),
    ("baidu", "fallback", 0.9, "cn", None),
    ("sogou", "fallback", 0.85, "cn", None),
    ("so360", "fallback", 0.8, "cn", None),
    ("startpage", "optional", 0.95, "global", None),
    ("brave", "optional", 0.95, "global", None),
    ("searxng", "optional", 0.9, "global", None),
    ("wikipedia", "api", 1.0, "global", None),
    ("hackernews", "api", 1.0, "dev", r"developer|programming|software|framework|library|release|api\b|hacker|startup|show hn"),
    ("github", "api", 1.0, "dev", r"github|repository|repo\b|library|package|sdk|framework|open[- ]source|cli\b|npm|pypi"),
    ("stackexchange", "api", 1.0, "dev", r"error|exception|how to|why does|fix\b|stack ?overflow|typescript|python|javascript|rust|java\b|sql\b|regex"),
    ("npm", "api", 0.95, "dev", r"npm|node(?:\.js)?|package|library|module"),
    ("crates", "api", 0.95, "dev", r"crate|rust|cargo"),
    ("arxiv", "api", 1.0, "academic", r"arxiv|paper|preprint|theorem|neural|transformer|benchmark|dataset"),
    ("openalex", "api", 1.0, "academic", r"study|research|paper|journal|citation|survey|meta[- ]analysis|clinical|trial"),
    ("crossref", "api", 0.95, "academic", r"doi|citation|journal|published|paper|study"),
    ("brave-api", "keyed", 1.15, "global", None),
    ("serper", "keyed", 1.15, "global", None),
    ("tavily", "keyed", 1.1, "global", None),
    ("exa", "keyed", 1.1, "global", None),
    ("google-cse", "keyed", 1.15, "global", None),
)
IDS = tuple(e[0] for e in ENGINES)
KEYLESS = tuple(e[0] for e in ENGINES if e[1] != "keyed" and e[0] != "searxng")


def engines(spark: SparkSession) -> DataFrame:
    """engine, engine_ord, tier, weight, affinity, triggers: 24 rows, safe to broadcast."""
    rows = [(e, i, t, w, a, r) for i, (e, t, w, a, r) in enumerate(ENGINES)]
    return spark.createDataFrame(rows, "engine string, engine_ord int, tier string, weight double, affinity string, triggers string")


def is_configured(engine: str, config: Config) -> bool:
    if engine not in IDS:
        return False
    if engine in KEYLESS:
        return True
    if engine == "google-cse":
        return bool(config.keys.get("google_cse_key") and config.keys.get("google_cse_cx"))
    return bool(config.keys.get("brave" if engine == "brave-api" else engine))


def catalogue(spark: SparkSession, config: Config) -> DataFrame:
    """The sources with whether each can run as configured."""
    ready = [e for e in IDS if is_configured(e, config)]
    return engines(spark).withColumn("configured", F.col("engine").isin(ready))
