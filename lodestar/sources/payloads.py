"""Answers of result sources as ranked rows.

An answer is a row (payload string[, base string, now timestamp]); ``rows(df, engine)`` explodes it into rank, title, url, snippet, published_at and
meta. JSON and XML are read by Spark's own parsers with the fields a source sends; result pages go through the HTML extractor with
selectors given here as data. Rows without a title or an address go.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import dates, text, url
from lodestar.functions.base import let
from lodestar.operators import html

C = F.col


def dotted(*parts: Column) -> Column:
    """Parts joined by middle dots; empty ones left out."""
    return F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != ""), " · ")


def some(*values: Column) -> Column:
    """The first that isn't empty."""
    return F.coalesce(*[F.when(v != "", v) for v in values])


@dataclass(frozen=True)
class Json:
    """A JSON source: the schema of an answer, where its rows are, and each row's fields (of ``r``; ``p`` is the answer, ``n`` the rank)."""

    schema: str
    rows: str
    title: Callable[[], Column]
    url: Callable[[], Column]
    snippet: Callable[[], Column]
    date: Callable[[], Column] = lambda: F.lit(None).cast("string")
    meta: Callable[[], dict[str, Column]] = dict
    cap: int = 480


def k(n: Column) -> Column:
    return F.format_number(n, 0)


def _strip_jats(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " ")


def inverted_text(index: Column) -> Column:
    """A word-to-places map as text; the first word at a place stays, places beyond 100,000 go."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(F.filter(e.value, lambda p: p.between(0, 100_000)), lambda p: F.struct(p.alias("at"), e.key.alias("word")))))
    # bound once: each place looks at the one before it
    first = let(F.array_sort(pairs), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["at"] != x["at"])))
    return F.array_join(F.transform(first, lambda x: x["word"]), " ")


def _names(a: Column, most: int = 3) -> Column:
    shown = F.slice(F.filter(a, lambda x: F.coalesce(x, F.lit("")) != ""), 1, most)
    return F.when(F.size(shown) > 0, F.concat(F.array_join(shown, ", "), F.when(F.size(a) > most, F.lit(" et al.")).otherwise(F.lit(""))))


JSON = {
    "hackernews": Json(
        "hits array<struct<objectID:string,title:string,url:string,story_text:string,points:int,num_comments:int,author:string,created_at:string>>",
        "p.hits",
        lambda: C("r.title"),
        lambda: some(C("r.url"), F.concat(F.lit("https://news.ycombinator.com/item?id="), C("r.objectID"))),
        lambda: some(text.strip_html(C("r.story_text")), dotted(F.concat(C("r.points").cast("string"), F.lit(" points")), F.concat(C("r.num_comments").cast("string"), F.lit(" comments")), F.concat(F.lit("by "), C("r.author")))),
        lambda: C("r.created_at"),
        lambda: {"points": C("r.points").cast("string"), "comments": C("r.num_comments").cast("string"), "author": C("r.author")},
    ),
    "github": Json(
        "items array<struct<full_name:string,html_url:string,description:string,stargazers_count:long,language:string,pushed_at:string,topics:array<string>,license:struct<spdx_id:string>>>, message string",
        "p.items",
        lambda: C("r.full_name"),
        lambda: C("r.html_url"),
        lambda: dotted(C("r.description"), F.concat(F.lit("★"), k(C("r.stargazers_count"))), C("r.language"), F.concat(F.lit("updated "), F.substr(C("r.pushed_at"), F.lit(1), F.lit(10)))),
        lambda: C("r.pushed_at"),
        lambda: {"stars": C("r.stargazers_count").cast("string"), "language": C("r.language"), "license": C("r.license.spdx_id")},
    ),
    "stackexchange": Json(
        "items array<struct<title:string,link:string,body:string,score:int,is_answered:boolean,answer_count:int,view_count:long,creation_date:long,tags:array<string>,owner:struct<display_name:string>>>, quota_remaining int",
        "p.items",
        lambda: text.decode_entities(C("r.title")),
        lambda: C("r.link"),
        lambda: some(text.strip_html(C("r.body")), dotted(F.concat(F.lit("score "), C("r.score").cast("string")), F.concat(C("r.answer_count").cast("string"), F.lit(" answers"), F.when(C("r.is_answered"), F.lit(" (accepted)")).otherwise(F.lit(""))), F.array_join(C("r.tags"), ", "))),
        lambda: C("r.creation_date").cast("string"),
        lambda: {"score": C("r.score").cast("string"), "answers": C("r.answer_count").cast("string"), "tags": F.array_join(C("r.tags"), ",")},
        400,
    ),
    "npm": Json(
        "objects array<struct<package:struct<name:string,version:string,description:string,date:string,keywords:array<string>,publisher:struct<username:string>,links:struct<npm:string,homepage:string,repository:string>>,downloads:struct<weekly:long,monthly:long>,score:struct<final:double>>>, total long",
        "p.objects",
        lambda: F.concat_ws("@", C("r.package.name"), C("r.package.version")),
        lambda: some(C("r.package.links.npm"), F.concat(F.lit("https://www.npmjs.com/package/"), C("r.package.name"))),
        lambda: dotted(C("r.package.description"), F.array_join(F.slice(C("r.package.keywords"), 1, 8), ", "), F.concat(k(C("r.downloads.weekly")), F.lit(" weekly downloads"))),
        lambda: C("r.package.date"),
        lambda: {"version": C("r.package.version"), "repository": C("r.package.links.repository")},
    ),
    "crates": Json(
        "crates array<struct<id:string,name:string,description:string,max_version:string,newest_version:string,downloads:long,recent_downloads:long,updated_at:string,repository:string,homepage:string,documentation:string>>, meta struct<total:long>",
        "p.crates",
        lambda: F.concat_ws("@", C("r.name"), some(C("r.max_version"), C("r.newest_version"))),
        lambda: F.concat(F.lit("https://crates.io/crates/"), some(C("r.id"), C("r.name"))),
        lambda: dotted(C("r.description"), F.concat(k(C("r.downloads")), F.lit(" downloads"))),
        lambda: C("r.updated_at"),
        lambda: {"repository": C("r.repository"), "documentation": C("r.documentation")},
    ),
    "crossref": Json(
        "message struct<items:array<struct<DOI:string,title:array<string>,abstract:string,URL:string,issued:struct<`date-parts`:array<array<int>>>,`container-title`:array<string>,author:array<struct<given:string,family:string>>,`is-referenced-by-count`:int,type:string>>,`total-results`:long>",
        "p.message.items",
        lambda: text.strip_html(F.get(C("r.title"), F.lit(0))),
        lambda: some(C("r.URL"), F.concat(F.lit("https://doi.org/"), C("r.DOI"))),
        lambda: some(text.strip_abstract_prefix(F.trim(_strip_jats(C("r.abstract")))), dotted(_names(F.transform(C("r.author"), lambda a: F.concat_ws(" ", a.given, a.family))), F.get(C("r.container-title"), F.lit(0)), F.get(F.get(C("r.issued.date-parts"), F.lit(0)), F.lit(0)).cast("string"))),
        lambda: dates.iso(dates.from_date_parts(F.get(C("r.issued.date-parts"), F.lit(0)))),
        lambda: {"doi": C("r.DOI"), "citations": C("r.is-referenced-by-count").cast("string"), "type": C("r.type")},
        400,
    ),
    "openalex": Json(
        "results array<struct<id:string,doi:string,display_name:string,publication_date:string,publication_year:int,cited_by_count:int,abstract_inverted_index:map<string,array<int>>,authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<landing_page_url:string,source:struct<display_name:string>>>>",
        "p.results",
        lambda: text.strip_html(C("r.display_name")),
        lambda: some(C("r.doi"), C("r.primary_location.landing_page_url"), C("r.id")),
        lambda: some(inverted_text(C("r.abstract_inverted_index")), dotted(_names(F.transform(C("r.authorships"), lambda a: a.author.display_name)), C("r.primary_location.source.display_name"), C("r.publication_year").cast("string"))),
        lambda: C("r.publication_date"),
        lambda: {"citations": C("r.cited_by_count").cast("string"), "venue": C("r.primary_location.source.display_name")},
        400,
    ),
    "searxng": Json(
        "results array<struct<url:string,title:string,content:string,engine:string,category:string,score:double,publishedDate:string>>, number_of_results long",
        "p.results",
        lambda: text.strip_html(C("r.title")),
        lambda: url.absolute_url(C("r.url"), C("base")),
        lambda: C("r.content"),
        lambda: C("r.publishedDate"),
        lambda: {"sourceEngine": C("r.engine"), "category": C("r.category"), "score": C("r.score").cast("string")},
    ),
    "brave-api": Json(
        "web struct<results:array<struct<title:string,url:string,description:string,page_age:string,age:string,profile:struct<long_name:string>,language:string>>>",
        "p.web.results",
        lambda: text.strip_html(C("r.title")),
        lambda: C("r.url"),
        lambda: C("r.description"),
        lambda: some(C("r.page_age"), C("r.age")),
        lambda: {"publisher": C("r.profile.long_name"), "language": C("r.language")},
    ),
    "serper": Json(
        "organic array<struct<title:string,link:string,snippet:string,date:string,position:int,sitelinks:array<struct<title:string,link:string>>>>, answerBox struct<title:string,answer:string,snippet:string,link:string>, knowledgeGraph struct<title:string,type:string,description:string>, peopleAlsoAsk array<struct<question:string>>, relatedSearches array<struct<query:string>>",
        "p.organic",
        lambda: C("r.title"),
        lambda: C("r.link"),
        lambda: C("r.snippet"),
        lambda: C("r.date"),
        lambda: {"position": C("r.position").cast("string"), "sitelinks": F.to_json(C("r.sitelinks")), **{name: F.when(C("n") == 1, F.to_json(C(f"p.{name}"))) for name in ("answerBox", "knowledgeGraph", "peopleAlsoAsk", "relatedSearches")}},
    ),
    "tavily": Json(
        "results array<struct<title:string,url:string,content:string,score:double,published_date:string>>, answer string",
        "p.results",
        lambda: C("r.title"),
        lambda: C("r.url"),
        lambda: C("r.content"),
        lambda: C("r.published_date"),
        lambda: {"score": C("r.score").cast("string"), "answer": F.when(C("n") == 1, C("p.answer"))},
        600,
    ),
    "exa": Json(
        "results array<struct<id:string,title:string,url:string,publishedDate:string,author:string,text:string,score:double,summary:string>>",
        "p.results",
        lambda: some(C("r.title"), C("r.url")),
        lambda: C("r.url"),
        lambda: some(C("r.text"), C("r.summary")),
        lambda: C("r.publishedDate"),
        lambda: {"author": C("r.author"), "score": C("r.score").cast("string")},
    ),
    "google-cse": Json(
        "items array<struct<title:string,link:string,displayLink:string,snippet:string,pagemap:struct<metatags:string>>>, searchInformation struct<totalResults:string,searchTime:double>, error struct<code:int,message:string>",
        "p.items",
        lambda: C("r.title"),
        lambda: C("r.link"),
        lambda: C("r.snippet"),
        lambda: F.coalesce(*[F.get_json_object(C("r.pagemap.metatags"), path) for path in ("$[0]['article:published_time']", "$['article:published_time']", "$[0].date", "$.date")]),
        lambda: {"displayLink": C("r.displayLink"), "totalResults": F.when(C("n") == 1, C("p.searchInformation.totalResults"))},
    ),
    "wikipedia": Json(
        "query struct<search:array<struct<title:string,snippet:string,timestamp:string,wordcount:int,size:int>>,searchinfo:struct<totalhits:long>>",
        "p.query.search",
        lambda: text.decode_entities(C("r.title")),
        lambda: F.concat(F.lit("https://"), some(F.regexp_extract(C("base"), r"^https?://([a-z-]+)\.wikipedia", 1), F.lit("en")), F.lit(".wikipedia.org/wiki/"), F.replace(F.replace(F.url_encode(F.replace(text.decode_entities(C("r.title")), F.lit(" "), F.lit("_"))), F.lit("%2F"), F.lit("/")), F.lit("%3A"), F.lit(":"))),
        lambda: C("r.snippet"),
        lambda: C("r.timestamp"),
        lambda: {"wordcount": C("r.wordcount").cast("string")},
    ),
}

# Selectors of result pages, most specific first.
PAGES: dict[str, list[dict[str, str]]] = {
    "duckduckgo": [{"container": ".result", "title": "a.result__a", "link": "a.result__a", "snippet": ".result__snippet"}, {"container": "tr", "title": "a.result-link", "link": "a.result-link", "snippet": ".result-snippet", "rows": "following"}],
    "mojeek": [{"container": "ul.results-standard li", "title": "h2 a", "link": "h2 a", "snippet": "p.s", "date": ".date, time"}],
    "bing": [{"container": "li.b_algo", "title": "h2 a", "link": "h2 a", "snippet": ".b_caption p, p", "date": ".news_dt"}],
    "baidu": [{"container": "div.result, div.c-container", "title": "h3 a", "link": "h3 a", "snippet": ".c-abstract, .content-right", "date": ".newTimeFactor_before_abs"}],
    "sogou": [{"container": "div.vrwrap, div.rb", "title": "h3 a", "link": "h3 a", "snippet": ".star-wiki, .str-text, .ft", "date": ".news-from"}],
    "so360": [{"container": "li.res-list", "title": "h3 a", "link": "h3 a", "snippet": ".res-desc, .res-rich", "date": ".mh-time"}],
    "startpage": [{"container": "div.result, .w-gl__result", "title": "h2, h3", "link": "a.result-title, a.result-link, a[href]", "snippet": "p.description, .w-gl__description", "date": "time"}],
    "brave": [{"container": "div.snippet", "title": ".title", "link": "a[href]", "snippet": ".snippet-description, .description", "date": ".age, time"}],
}
#: Where a box of a page names its destination, in order of preference.
TARGETS = ("mu", "data-landurl", "data-mdurl", "data-url")
XML = ("arxiv", "googlenews")
ENGINES = (*PAGES, *XML, *JSON)


def _inputs(df: DataFrame) -> DataFrame:
    for name, value in (("base", F.lit("https://example.invalid/")), ("now", F.current_timestamp())):
        if name not in df.columns:
            df = df.withColumn(name, value)
    return df.withColumn("payload", F.regexp_replace("payload", r"^\)\]\}'?,?\s*", ""))


def rows(df: DataFrame, engine: str, limit: int = 20) -> DataFrame:
    """The answers of one source as rows; the other columns of ``df`` stay."""
    kept = [c for c in df.columns if c not in ("payload", "base", "now")]
    df = _inputs(df)
    if engine in JSON:
        s = JSON[engine]
        found = df.withColumn("p", F.from_json("payload", s.schema)).select("*", F.posexplode(F.slice(F.col(s.rows), 1, limit)).alias("i", "r")).withColumn("n", F.col("i") + 1)
        meta = s.meta()
        made = F.struct(C("n").alias("rank"), s.title().alias("title"), s.url().alias("url"), s.snippet().alias("said"), s.date().alias("date"), _meta(meta))
        out = url.bound(found.select(*kept, "now", made.alias("m")), "m").select(*kept, "now", "m.*")
        out = out.withColumn("snippet", text.clean_snippet(C("said"), s.cap)).withColumn("published_at", dates.parse_loose(C("date"), C("now")))
    elif engine == "arxiv":
        found = df.withColumn("e", _entries(C("payload"), "entry")).select("*", F.posexplode(F.slice("e", 1, limit)).alias("i", "x"))
        tag = lambda t: text.collapse_spaces(text.decode_entities(F.regexp_replace(F.regexp_extract(C("x"), rf"(?s)<{t}[^>]*>(.*?)</{t}>", 1), r"\s+", " ")))
        many = lambda p: F.array_join(F.regexp_extract_all(C("x"), F.lit(p), 1), ", ")
        out = found.select(*kept, (C("i") + 1).alias("rank"), tag("title").alias("title"), F.regexp_replace(tag("id"), "^http:", "https:").alias("url"), text.truncate(text.strip_abstract_prefix(tag("summary")), 500).alias("snippet"), dates.parse_loose(tag("published"), C("now")).alias("published_at"), _meta({"authors": many(r"(?s)<author>\s*<name>(.*?)</name>"), "categories": many(r'<category[^>]*term="([^"]*)"')}))
    elif engine == "googlenews":
        found = df.withColumn("e", _entries(C("payload"), "item")).select("*", F.posexplode(F.slice("e", 1, limit)).alias("i", "x"))
        raw = lambda t: F.trim(F.regexp_replace(F.regexp_extract(C("x"), rf"(?s)<{t}[^>]*>(.*?)</{t}>", 1), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"))
        title, source = text.decode_entities(raw("title")), text.decode_entities(raw("source"))
        publisher = some(source, F.when(F.length(F.regexp_extract(title, r"^.* - ([^-]+)$", 1)) <= 40, F.regexp_extract(title, r"^.* - ([^-]+)$", 1)))
        bare = F.when(F.endswith(title, F.concat(F.lit(" - "), publisher)), F.substr(title, F.lit(1), F.length(title) - F.length(publisher) - 3)).otherwise(title)
        said = text.strip_html(text.decode_entities(raw("description")))
        about = F.trim(F.replace(F.replace(said, bare, F.lit("")), publisher, F.lit("")))
        out = found.select(*kept, (C("i") + 1).alias("rank"), bare.alias("title"), raw("link").alias("url"), F.when(F.length(about) >= 16, text.clean_snippet(about)).otherwise(F.lit("")).alias("snippet"), F.coalesce(dates.mail_date(raw("pubDate")), dates.parse_loose(raw("pubDate"), C("now"))).alias("published_at"), _meta({"publisher": publisher}))
    else:
        found = df.withColumn("e", html.results_of(C("payload"), C("base"), PAGES[engine], limit)).select("*", F.posexplode("e").alias("i", "r"))
        target = F.coalesce(*[F.when(C("r.attrs")[t].rlike(r"(?i)^https?://") & ~F.contains(C("r.attrs")[t], F.lit("nourl")), C("r.attrs")[t]) for t in TARGETS])
        plain = url.unwrap_redirect(C("r.url")) if engine == "duckduckgo" else F.coalesce(F.when(C("r.url").rlike("/ck/a"), url.wrapper_target(C("r.url"))), C("r.url"))
        title = text.strip_host_prefix(C("r.title")) if engine in ("bing", "duckduckgo") else C("r.title")
        said = text.clean_snippet(C("r.snippet"))
        out = found.select(*kept, (C("i") + 1).alias("rank"), title.alias("title"), F.coalesce(target, plain).alias("url"), F.when(text.is_useless_snippet(said, title), F.lit("")).otherwise(said).alias("snippet"), dates.parse_loose(F.coalesce(C("r.date"), F.lit("")), C("now")).alias("published_at"), _meta({"wrapper": F.when(target.isNotNull(), C("r.url"))}))
    row = F.struct("rank", "title", "url", "snippet", "published_at", "meta")
    done = url.bound(out.select(*kept, row.alias("_row")), "_row").select(*kept, F.lit(engine).alias("engine"), "_row.*")
    return done.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))


def _entries(c: Column, tag: str) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"(?s)(<{tag}[\s>].*?</{tag}>)"), 1)


def _meta(values: dict[str, Column]) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>").alias("meta")
    return F.map_filter(F.create_map(*[x for name, v in values.items() for x in (F.lit(name), v.cast("string"))]), lambda _, v: F.coalesce(v, F.lit("")) != "").alias("meta")


def all_rows(payloads: DataFrame, limit: int = 20) -> DataFrame:
    """Answers of all sources: ``payloads`` has engine besides payload (and base, now)."""
    out = None
    for engine in ENGINES:
        part = rows(payloads.filter(F.col("engine") == engine).drop("engine"), engine, limit)
        out = part if out is None else out.unionByName(part)
    return out


def quota_error(payload: Column) -> Column:
    """The message of an answer that refuses for want of quota, or null."""
    e = F.from_json(payload, "error struct<code:int,message:string>, message string")["error"]
    return F.when(e["code"] == 429, F.concat(F.lit("blocked: "), F.coalesce(e["message"], F.lit("quota exceeded"))))


def arxiv_query(query: Column) -> Column:
    """Queries with field prefixes pass; others search all fields."""
    return F.when(query.rlike(r"(?i)\b(ti|au|abs|co|jr|cat|rn|id|all):"), query).otherwise(F.concat(F.lit("all:"), query))
