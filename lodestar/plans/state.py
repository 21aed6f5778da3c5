"""Queries on stored state, policies, dates, documents and payloads."""

from __future__ import annotations

import io
import json
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import dates, policy, text
from lodestar.operators import cache, html, office, render
from lodestar.session import shared_folder
from lodestar.sources import payloads, registry
from lodestar.streaming import breaker

from .common import table
from .texts import q

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


#: The time at which the queries look at the events, which span January 2024 or so.
NOW = "(select max(ts) from events)"


def now_of(events: DataFrame):
    return F.lit(events.agg(F.max("ts").alias("t")).first().t).cast("timestamp")  # one value


@query("cache_latest", "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def cache_latest(spark: SparkSession, d: str) -> DataFrame:
    return cache.latest(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "value")


@query("cache_upsert", "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A table of the first half of the events, upserted with the second."""
    events = table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    cut = events.agg(F.percentile("event_id", 0.5).alias("m")).first().m
    order = F.col("at") <= F.lit(None) if cut is None else F.col("event_id") < cut
    middle = events.filter(order)
    rest = events.filter(~order)
    old = cache.latest(middle, ["user_id"], [F.col("at")])
    both = cache.upsert(old, cache.latest(rest.unionByName(old), ["user_id"], [F.col("at")]), ["user_id"], "at")
    return both.select("user_id", "event_id")


@query("cache_ttl_hits", f"select event_id from events where epoch_us({NOW}) - epoch_us(ts) <= 86400000000")
def cache_ttl_hits(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return cache.hits(events.withColumn("ts", F.col("ts").cast("timestamp")), 86_400, now_of(events), "ts").select("event_id")


@query("cache_prune", f"select event_id from events where epoch_us({NOW}) - epoch_us(ts) <= 864000000000 order by ts desc, event_id limit 500")
def cache_prune(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return cache.prune(events.withColumn("ts", F.col("ts").cast("timestamp")), now_of(events), 864_000, 500, "ts", "event_id").select("event_id")


@query("cache_stats", "select count(*) as n, epoch_us(min(ts)) as oldest, epoch_us(max(ts)) as newest from events")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    s = cache.stats(table(spark, d, "events"), "ts")
    return s.select("n", F.unix_micros(F.col("oldest").cast("timestamp")).alias("oldest"), F.unix_micros(F.col("newest").cast("timestamp")).alias("newest"))


@query("cache_keep_newest", "select user_id from (select user_id, max(event_id) as e from events group by 1 order by e desc limit 20)")
def cache_keep_newest(spark: SparkSession, d: str) -> DataFrame:
    return cache.keep_newest(table(spark, d, "events"), 20, "user_id", "event_id").select("user_id")


@query("cache_key", "select event_id, event_type || '::' || regexp_replace(lower(trim(event_type || '  Query ' || user_id)), '\\s+', ' ', 'g') || '::limit=' || user_id as key from events")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    extra = F.create_map(F.lit("region"), F.lit(""), F.lit("limit"), F.col("user_id").cast("string"))
    return events.select("event_id", text.search_cache_key(F.col("event_type"), F.concat("event_type", F.lit("  Query "), F.col("user_id").cast("string")), extra).alias("key"))


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """The events as attempts of 24 engines; errors fail, in three kinds."""
    events = table(spark, d, "events")
    error = F.when(F.col("event_id") % 5 == 0, "HTTP 429 (rate limited)").when(F.col("event_id") % 5 == 1, "ECONNREFUSED 10.0.0.1").otherwise("read timeout")
    return events.select(
        F.element_at(F.array(*[F.lit(e) for e in registry.IDS]), (F.col("user_id") % 24 + 1).cast("int")).alias("engine"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_type") != "error", (F.col("user_id") % 10).cast("long")).otherwise(F.lit(0)).alias("results"),
        F.col("value").alias("latency_ms"), F.when(F.col("event_type") == "error", error).alias("error"),
    )


_IDS = q(registry.IDS)
_ATT = f"att as (select ([{_IDS}])[user_id % 24 + 1] as engine, ts, event_id as seq, event_type <> 'error' as ok, case when event_type <> 'error' then user_id % 10 else 0 end as results, value as latency, case when event_id % 5 = 0 then 'blocked' when event_id % 5 = 1 then 'unreachable' else 'other' end as kind from events)"
_FOLD = f"""{_ATT}, i as (select *, sum(ok::int) over (partition by engine order by ts, seq) as island from att),
c as (select *, sum((not ok)::int) over (partition by engine, island order by ts, seq) as failures from i),
b as (select *, case when not ok and failures >= case when kind = 'other' then 3 else 1 end then epoch_us(ts) + case when kind = 'unreachable' then 300000000 else 600000000 end end as until, max(island) over (partition by engine) as last_island from c),
st as (select engine, coalesce(sum((not ok and island = last_island)::int), 0)::bigint as consecutive_failures, coalesce(arg_max(until, struct_pack(a := ts, b := seq)) filter (where until is not null and island = last_island), 0)::bigint as benched_until_us, count(*) as total_calls, sum((not ok)::int)::bigint as total_failures, sum(results)::bigint as total_results from b group by engine)"""


@query("breaker_state", f"with {_FOLD} select * from st")
def breaker_state(spark: SparkSession, d: str) -> DataFrame:
    return breaker.state(attempts(spark, d)).select("engine", "consecutive_failures", "benched_until_us", "total_calls", "total_failures", "total_results")


@query("breaker_replay", f"with {_FOLD} select * from st")
def breaker_replay(spark: SparkSession, d: str) -> DataFrame:
    return breaker.replay(attempts(spark, d)).select("engine", "consecutive_failures", "benched_until_us", "total_calls", "total_failures", "total_results")


@query("failures_in_a_row", f"with {_FOLD} select seq, failures::bigint as failures from c")
def failures_in_a_row(spark: SparkSession, d: str) -> DataFrame:
    return breaker.failures_in_a_row(attempts(spark, d)).select("seq", "failures")


@query("engine_health_snapshot", f"with {_FOLD}, e as (select unnest([{_IDS}]) as engine), n as (select epoch_us(max(ts)) as now from events) select e.engine, coalesce(consecutive_failures, 0) = 0 and coalesce(benched_until_us, 0) <= now as ok, coalesce(total_results, 0) as results, coalesce(benched_until_us, 0) > now as skipped from e left join st on e.engine = st.engine, n")
def engine_health_snapshot(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return breaker.snapshot(registry.engines(spark), breaker.state(attempts(spark, d)), now_of(events)).select("engine", "ok", "results", "skipped")


@query("engine_sweep", f"with {_ATT}, e as (select unnest([{_IDS}]) as engine), l as (select engine, arg_max(case when not ok then kind when results = 0 then 'empty' else 'ok' end, struct_pack(a := ts, b := seq)) as outcome from att group by 1) select e.engine, coalesce(outcome, 'untried') as outcome from e left join l on e.engine = l.engine")
def engine_sweep(spark: SparkSession, d: str) -> DataFrame:
    return breaker.sweep(registry.engines(spark), attempts(spark, d)).select("engine", "outcome")


@query("breaker_stream", f"with {_FOLD} select * from st")
def breaker_stream(spark: SparkSession, d: str) -> DataFrame:
    """The breaker as a stream over the events' files, all that are there; the last state of each engine."""
    out = f"{shared_folder(spark)}/lodestar-breaker-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    base = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet" if _is_folder(spark, f"{d}/events.parquet") else f"{d}/[e]vents.parquet")
    error = F.when(F.col("event_id") % 5 == 0, "HTTP 429 (rate limited)").when(F.col("event_id") % 5 == 1, "ECONNREFUSED 10.0.0.1").otherwise("read timeout")
    rows = base.select(F.element_at(F.array(*[F.lit(e) for e in registry.IDS]), (F.col("user_id") % 24 + 1).cast("int")).alias("engine"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") != "error", (F.col("user_id") % 10).cast("long")).otherwise(F.lit(0)).alias("results"), F.col("value").alias("latency_ms"), F.when(F.col("event_type") == "error", error).alias("error"))
    states = breaker.stream(rows)
    put = breaker.upsert_sink(f"{out}/state", ["engine"], "total_calls")
    states.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/checkpoint").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return breaker.read_sink(spark, f"{out}/state", states.schema).select("engine", "consecutive_failures", "benched_until_us", "total_calls", "total_failures", "total_results")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory())


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


FAILURES = [("HTTP 429 (rate limited)", "blocked"), ("captcha challenge", "blocked"), ("getaddrinfo ENOTFOUND x", "unreachable"), ("ECONNREFUSED", "unreachable"), ("read timeout", "other"), ("HTTP 500", "other")]


@query("failure_classes", "select * from (values " + ", ".join(f"({q([m])}, '{k}')" for m, k in FAILURES) + ") v(message, kind)")
def failure_classes(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, [(m,) for m, _ in FAILURES], "message string").withColumn("kind", policy.failure_kind(F.col("message")))


BLOCKS = [(429, "", "HTTP 429 (rate limited)"), (403, "x", "HTTP 403 (blocked)"), (503, "a Captcha", "HTTP 503 (challenge)"), (500, "", "HTTP 500"), (200, "Please solve the hCaptcha", "captcha challenge"), (200, "", "empty response body (likely blocked)"), (200, '<a class="r" href="/x">', None), (200, "z" * 600, None)]


@query("block_reasons", "select * from (values " + ", ".join(f"({i}, {'null' if r is None else q([r])})" for i, (_, _, r) in enumerate(BLOCKS)) + ") v(i, reason)")
def block_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = _values(spark, [(i, s, b) for i, (s, b, _) in enumerate(BLOCKS)], "i int, status int, body string")
    return rows.select("i", policy.block_reason(F.col("status"), F.col("body")).alias("reason"))


DATES = [("2 days ago", "2025-06-13T12:00:00.000Z"), ("2024-01-05", "2024-01-05T00:00:00.000Z"), ("2024-01-05T10:11:12.345+09:00", "2024-01-05T10:11:12.000Z"), ("1700000000", "2023-11-14T22:13:20.000Z"), ("1700000000123", "2023-11-14T22:13:20.123Z"), ("5 分钟前", "2025-06-15T11:55:00.000Z"), ("昨天", "2025-06-14T12:00:00.000Z"), ("3 months ago", "2025-03-17T12:00:00.000Z"), ("10m ago", "2025-06-15T11:50:00.000Z"), ("Jan 5, 2024", "2024-01-05T00:00:00.000Z"), ("5th September 2023", "2023-09-05T00:00:00.000Z"), ("2024年1月5日", "2024-01-05T00:00:00.000Z"), ("nonsense", None), ("", None), ("Tue, 05 Mar 2024 10:00:00 GMT", "2024-03-05T00:00:00.000Z")]


@query("date_parse", "select * from (values " + ", ".join(f"({i}, {'null' if r is None else q([r])})" for i, (_, r) in enumerate(DATES)) + ") v(i, iso)")
def date_parse(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2025-06-15 12:00:00").cast("timestamp")
    rows = _values(spark, [(i, s) for i, (s, _) in enumerate(DATES)], "i int, s string")
    return rows.select("i", dates.iso(dates.parse_loose(F.col("s"), now)).alias("iso"))


ROBOTS = "User-agent: *\nDisallow: /docs\nAllow: /docs/public\nDisallow: /*.gif$\n\nUser-agent: lodestar\nUser-agent: other\nDisallow: /private # no\nCrawl-delay: 99\n"


@query("robots_allowed", "select page_id, not regexp_matches(url, '^[a-z]+://[^/]*/en(/|$|[?#])') or regexp_matches(url, '^[a-z]+://[^/]*/en/1') as allowed from pages")
def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    """English pages are disallowed, but for those whose number starts with 1."""
    from lodestar.functions import url

    rules = F.lit("User-agent: *\nDisallow: /en/\nAllow: /en/1\n")
    pages = url.with_url(table(spark, d, "pages").select("page_id", "url"))
    parsed = pages.withColumn("rules", policy.robots_rules(F.concat(rules, F.lit("")))["rules"])
    return parsed.select("page_id", policy.path_allowed(F.col("rules"), F.col("u.path")).alias("allowed"))


@query("json_extract_props", "select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.none') as none from events")
def json_extract_props(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"), F.try_variant_get(v, "$.none", "string").alias("none"))


@query("corpus_rollup", "select lang, source, count(*) as n, sum(n_chars)::bigint as chars from documents group by rollup (lang, source)")
def corpus_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("corpus_cube", "select lang, source, count(*) as n from documents group by cube (lang, source)")
def corpus_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("html_markdown")
def html_markdown(spark: SparkSession, d: str) -> DataFrame:
    done = html.pages_to_markdown(table(spark, d, "pages"))
    return done.select("page_id", "page.title", "page.markdown", "page.language", "page.extractor", "word_count")


@query("rendered_search")
def rendered_search(spark: SparkSession, d: str) -> DataFrame:
    from .texts import topics

    queries, found = topics(spark, d)
    return render.search_results(queries, found, F.lit("2025-06-15").cast("timestamp"))


def container(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, said in parts.items():
            z.writestr(zipfile.ZipInfo(name), said)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
SAMPLES = {
    "a.docx": container({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Hel</w:t></w:r><w:r><w:t>lo</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'}),
    "a.xlsx": container({"xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets><sheet name="Data" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><r><t>va</t></r><r><t>lue</t></r></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>1</v></c><c r="C2"><v>2.5</v></c></row></sheetData></worksheet>'}),
    "a.pptx": container({f"ppt/slides/slide{i}.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>Slide {i}</a:t></a:r></a:p></p:sld>' for i in (10, 2, 1)}),
    "a.odt": container({"content.xml": '<o:doc xmlns:o="o" xmlns:text="t"><o:text><text:h text:outline-level="2">Head</text:h><text:p>one <text:span>two</text:span> three</text:p></o:text></o:doc>'}),
    "a.epub": container({"META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>', "o/c.opf": '<package><metadata><title>Book</title></metadata><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>', "o/a.xhtml": "<html><body><h1>Second</h1><p>" + "later words " * 9 + "</p></body></html>", "o/b.xhtml": "<html><body><h1>First</h1><p>" + "early words " * 9 + "</p></body></html>"}),
    "a.csv": 'name;note\n"Doe; J";"said ""hi"""\r\nx;y'.encode(),
    "a.json": json.dumps({"a": [1, 2], "b": {"c": None}}).encode(),
    "a.txt": b"plain text",
    "page": b"<!doctype html><title>T</title><p>" + b"some words " * 20,
    "a.pdf": b"%PDF-1.4\n1 0 obj\n<< /Length 44 >>\nstream\nBT /F1 12 Tf (Hello) Tj T* (world) Tj ET\nendstream\nendobj",
    "broken.docx": b"PK not a zip",
}


@query("documents_parsed")
def documents_parsed(spark: SparkSession, d: str) -> DataFrame:
    files = spark.createDataFrame([(n, bytearray(b)) for n, b in SAMPLES.items()], "path string, content binary")
    return office.parse_documents(files).select("path", "document.kind", "document.title", "document.markdown", "document.chars")


PAYLOADS = {
    "hackernews": {"hits": [{"objectID": "1", "title": "Story", "url": "", "points": 5, "num_comments": 2, "author": "x", "created_at": "2024-01-05T00:00:00Z"}, {"objectID": "2", "title": "", "url": "https://a.b/c"}]},
    "github": {"items": [{"full_name": "a/b", "html_url": "https://github.com/a/b", "description": "lib", "stargazers_count": 1234, "language": "Go", "pushed_at": "2024-02-03T00:00:00Z"}]},
    "stackexchange": {"items": [{"title": "How &amp; why", "link": "https://stackoverflow.com/q/1", "score": 3, "is_answered": True, "answer_count": 2, "creation_date": 1700000000, "tags": ["sql"]}]},
    "npm": {"objects": [{"package": {"name": "p", "version": "1.0.0", "description": "d", "date": "2024-01-01", "keywords": ["k"], "links": {"npm": "https://www.npmjs.com/package/p"}}, "downloads": {"weekly": 5000}}]},
    "crates": {"crates": [{"id": "c", "name": "c", "description": "d", "newest_version": "0.1.0", "downloads": 10, "updated_at": "2024-01-01T00:00:00.123Z"}]},
    "crossref": {"message": {"items": [{"DOI": "10.1/x", "title": ["Paper"], "URL": "https://doi.org/10.1/x", "issued": {"date-parts": [[2020, 5]]}, "author": [{"given": "A", "family": "B"}], "abstract": "<jats:p>Abstract: text of it</jats:p>"}]}},
    "openalex": {"results": [{"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1/y", "display_name": "Work", "publication_date": "2021-02-03", "abstract_inverted_index": {"graphs": [1], "Large": [0], "grow": [2, 4], "and": [3]}}]},
    "searxng": {"results": [{"url": "/rel", "title": "R", "content": "content of a row", "engine": "e", "score": 1.5}]},
    "brave-api": {"web": {"results": [{"title": "<b>T</b>", "url": "https://a.b/", "description": "some description", "page_age": "2024-01-01T00:00:00"}]}},
    "serper": {"organic": [{"title": "One", "link": "https://a.b/1", "snippet": "first snippet here", "position": 1}, {"title": "Two", "link": "https://a.b/2", "snippet": "second snippet here", "position": 2}], "answerBox": {"answer": "42"}},
    "tavily": {"results": [{"title": "T", "url": "https://a.b/", "content": "the content here", "score": 0.5}], "answer": "yes"},
    "exa": {"results": [{"title": "", "url": "https://a.b/", "text": "the text goes here", "publishedDate": "2024-01-01"}]},
    "google-cse": {"items": [{"title": "G", "link": "https://a.b/", "snippet": "a snippet of it", "pagemap": {"metatags": [{"article:published_time": "2024-05-06"}]}}]},
    "wikipedia": {"query": {"search": [{"title": "Spark (fire)", "snippet": 'a <span class="searchmatch">spark</span> of fire', "timestamp": "2024-01-01T00:00:00Z"}]}},
}
_ROW = lambda i: f'<h2><a href="https://r{i}.example.com/p">Result number {i}</a></h2><p class="s">Snippet text of result {i}, long enough.</p>'
MARKUP = {
    "mojeek": "<ul class='results-standard'>" + "".join(f"<li>{_ROW(i)}</li>" for i in range(4)) + "</ul>",
    "bing": "".join(f"<li class='b_algo'><h2><a href='https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9{x}'>Result {x}</a></h2><p>Snippet text that is long enough.</p></li>" for x in ("hLmV4YW1wbGUuY29tLw", "iLmV4YW1wbGUuY29tLw", "jLmV4YW1wbGUuY29tLw")),
    "duckduckgo": "".join(f"<div class='result'><a class='result__a' href='//duckduckgo.com/l/?uddg=https%3A%2F%2Fr{i}.example.com%2F'>Result number {i}</a><a class='result__snippet'>A snippet that is long enough.</a></div>" for i in range(3)),
    "baidu": "".join(f"<div class='result c-container' mu='https://r{i}.example.com/'><h3><a href='http://www.baidu.com/link?url=x{i}'>Result number {i}</a></h3><div class='c-abstract'>A snippet that is long enough.</div></div>" for i in range(3)),
    "sogou": "".join(f"<div class='vrwrap'><h3><a href='/link?url=x{i}'>Result number {i}</a></h3><div class='str-text'>A snippet that is long enough.</div></div>" for i in range(3)),
    "so360": "".join(f"<li class='res-list' data-mdurl='https://r{i}.example.com/'><h3><a href='https://www.so.com/link?m={i}'>Result number {i}</a></h3><p class='res-desc'>A snippet that is long enough.</p></li>" for i in range(3)),
    "startpage": "".join(f"<div class='result'><a class='result-link' href='https://r{i}.example.com/'><h2>Result number {i}</h2></a><p class='description'>A snippet that is long enough.</p></div>" for i in range(3)),
    "brave": "".join(f"<div class='snippet'><a href='https://r{i}.example.com/'><div class='title'>Result number {i}</div></a><div class='snippet-description'>A snippet that is long enough.</div></div>" for i in range(3)),
    "arxiv": "<feed><entry><id>http://arxiv.org/abs/1</id><title>A\n paper</title><summary>Abstract: we show</summary><published>2024-01-02T00:00:00Z</published><author><name>A. B</name></author><category term='cs.CL'/></entry></feed>",
    "googlenews": "<rss><channel><item><title>News today - The Paper</title><link>https://news.example.com/1</link><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate><source url='https://p.example.com'>The Paper</source><description>&lt;a href='x'&gt;News today&lt;/a&gt; The Paper</description></item></channel></rss>",
}


@query("engine_payloads")
def engine_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Written answers of all 24 sources as rows."""
    said = [(e, json.dumps(p)) for e, p in PAYLOADS.items()] + list(MARKUP.items())
    rows = spark.createDataFrame(said, "engine string, payload string").withColumn("base", F.lit("https://search.example.org/")).withColumn("now", F.lit("2025-06-15 12:00:00").cast("timestamp"))
    return payloads.all_rows(rows).select("engine", "rank", "title", "url", "snippet", dates.iso(F.col("published_at")).alias("published_at"), F.to_json("meta").alias("meta"))


@query("response_cache", "select event_id from (select event_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as before from events) where before is null or epoch_us(ts) - epoch_us(before) > 900000000")
def response_cache(spark: SparkSession, d: str) -> DataFrame:
    """Requests that the response cache could not serve: none of the same key came within 15 minutes."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("before", F.lag("ts").over(order))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return rows.filter(F.col("before").isNull() | (micros("ts") - micros("before") > 900_000_000)).select("event_id")
