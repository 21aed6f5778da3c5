"""Operators against worked examples."""

import functools
import operator

import pytest
from pyspark.sql import functions as F

from lodestar.api import Engine
from lodestar.config import Config
from lodestar.functions import text
from lodestar.operators import cache, fusion, html, index, office, passages, planner, render, research
from lodestar.plans import state
from lodestar.streaming import breaker

LISTS = "query_id long, engine string, engine_ord int, weight double, rank int, title string, url string, snippet string, published_at timestamp"


def lists(spark, spec):
    rows = [(1, e, i, w, r, t, u, s, None) for i, (e, w, found) in enumerate(spec) for r, (t, u, s) in enumerate(found, 1)]
    return spark.createDataFrame(rows, LISTS)


def test_agreement_wins(spark):
    df = lists(spark, [("alpha", 1.0, [("Both", "https://www.both.example.com/", "short"), ("A", "https://a.example.com/x", "")]), ("beta", 1.0, [("B", "https://b.example.org", ""), ("Both of them", "https://both.example.com", "a longer one")])])
    got = {r.url: r for r in fusion.fuse(df).collect()}
    both = got["https://both.example.com/"]
    assert both.score == pytest.approx(round(1 / 61 + 1 / 62 + 0.12, 6)) and both.engines == ["alpha", "beta"] and both.best_rank == 1
    assert both.title == "Both of them" and both.snippet == "a longer one" and both.source == "example.com"


def test_a_list_counts_a_page_once(spark):
    df = lists(spark, [("a", 1.0, [("X", "https://x.com/p", ""), ("X again", "https://x.com/p/", ""), ("Y", "https://y.com", ""), ("bad", "nothing", "")])])
    got = {r.url: r for r in fusion.fuse(df).collect()}
    assert got["https://x.com/p"].score == round(1 / 61, 6) and got["https://y.com/"].best_rank == 3


def results(spark, sources):
    rows = [(1, f"https://{s}.com/{i}", s, i, f"t{i}") for i, s in enumerate(sources, 1)]
    return spark.createDataFrame(rows, "query_id long, url string, source string, pos int, title string")


def test_diversity_and_caps(spark):
    df = results(spark, "aaabbc")
    assert [r.source for r in fusion.diversify(df, 2).orderBy("pos").collect()] == list("abcaba")
    assert [r.pos for r in fusion.cap_domains(df, 1).orderBy("url").collect()] == [1, 4, 5, 2, 6, 3]


def test_title_duplicates(spark):
    df = lists(spark, [("a", 1.0, [("The very same title of it", "https://x.com/1", ""), ("Other thing here", "https://x.com/2", "")]), ("b", 1.0, [("The very same title of it", "https://www.x.com/3", ""), ("The very same title of it", "https://y.com/1", "")])])
    got = {r.url: r for r in fusion.dedupe_titles(fusion.fuse(df, consensus_bonus=0)).collect()}
    assert set(got) == {"https://x.com/1", "https://x.com/2", "https://y.com/1"}
    assert got["https://x.com/1"].engines == ["a", "b"] and got["https://x.com/1"].score == round(round(1 / 61, 6) * 1.25, 6)


def test_merge_and_rewrite(spark):
    a = spark.createDataFrame([(1, "k1", 1, "T", "", None), (2, "k2", 1, "V", "v", None)], "query_id long, key string, pos int, title string, snippet string, published_at timestamp")
    b = spark.createDataFrame([(1, "k2", 1, "U", "u", None), (1, "k1", 2, "x", "filled", None)], a.schema)
    merged = fusion.merge_lists(a, b).orderBy("query_id", "pos").collect()
    assert [(r.query_id, r.pos, r.key, r.title, r.snippet) for r in merged] == [(1, 1, "k1", "T", "filled"), (1, 2, "k2", "U", "u"), (2, 1, "k2", "V", "v")]
    df = lists(spark, [("a", 1.0, [("W", "https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9hLmIvYw", ""), ("P", "https://p.q/r", "")])])
    assert [r.url for r in fusion.rewrite_urls(df).orderBy("rank").collect()] == ["https://a.b/c", "https://p.q/r"]


DOCS = [(1, "Protocols", "The protocol describes a handshake between peers."), (2, "Cooking", "Slow cooking of beans and rice."), (3, "窗口", "模型的上下文窗口"), (4, "Filler", "nothing of note"), (5, "Café", "Un café crème")]


def test_search(spark):
    built = index.build(spark.createDataFrame(DOCS, "doc_id long, title string, content string"))
    queries = spark.createDataFrame([(1, "proto"), (2, "上下文"), (3, "cooking handshake"), (4, "CAFE"), (5, "")], "query_id long, query string")
    got = {}
    for r in index.search(built, queries).orderBy("query_id", "pos").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
        assert r.score > 0
    assert got == {1: [1], 2: [3], 4: [5]}
    again = index.refresh(built, spark.createDataFrame([(2, "Changed", "protocol too")], "doc_id long, title string, content string"))
    assert sorted(r.doc_id for r in index.search(again, queries.filter("query_id = 1")).collect()) == [1, 2]
    shown = index.highlight(spark.createDataFrame([("proto", DOCS[0][2])], "query string, content string")).collect()[0].snippet
    assert "«protocol»" in shown


def test_index_round_trip(spark, tmp_path):
    built = index.build(spark.createDataFrame(DOCS, "doc_id long, title string, content string"))
    built.write(str(tmp_path), 2)
    queries = spark.createDataFrame([(1, "beans")], "query_id long, query string")
    assert [r.doc_id for r in index.search(index.Index.read(spark, str(tmp_path)), queries).collect()] == [2]


def test_passages(spark):
    body = "# Widgets\n\nintro of the page\n\n" + "The widget pipeline assembles parts in order, and the widget is tested twice before it leaves. " * 2 + "\n\n" + "unrelated words " * 30
    rows = spark.createDataFrame([(1, 1, body, ["widget", "pipeline"]), (2, 1, "short text only", ["zzz"]), (3, 1, None, ["zzz"])], "doc_id long, query_id long, content string, terms array<string>")
    got = {r.doc_id: r.passages for r in passages.select_passages(rows).collect()}
    assert any("assembles" in p.text for p in got[1]) and all(body[p.offset : p.offset + 10] == p.text[:10] for p in got[1])
    assert got[2][0].text == "short text only" and got[2][0].score == 0 and got[3] == []


def test_choice_of_sources(spark):
    rows = [(1, "https://a.com/1", "a.com", 0.9, ["x"], 1), (1, "https://a.com/2", "a.com", 0.8, ["x"], 2), (1, "https://b.com/1", "b.com", 0.1, ["x", "y"], 3), (1, "https://www.youtube.com/w", "youtube.com", 2.0, ["x"], 4), (1, "https://linux.com/a", "linux.com", 0.05, ["x"], 5), (1, "https://c.com/f.zip", "c.com", 2.0, ["x"], 6)]
    df = spark.createDataFrame(rows, "query_id long, url string, source string, score double, engines array<string>, seq long")
    urls = lambda n: [r.url for r in research.choose_sources(df, n).orderBy("pos").collect()]
    assert urls(2) == ["https://a.com/1", "https://b.com/1"] and urls(4) == ["https://a.com/1", "https://b.com/1", "https://linux.com/a", "https://a.com/2"]


def test_expansion(spark):
    found = spark.createDataFrame([(1, i, f"Sprocket number{i}", "gasket of Rubber") for i in range(1, 4)] + [(1, 4, "sprocket gasket", "x"), (1, 5, "other", "y")], "query_id long, pos int, title string, snippet string")
    got = [r.query for r in research.expand_queries(spark.createDataFrame([(1, "machine")], "query_id long, query string"), found).orderBy("n").collect()]
    assert got == ["machine gasket", "machine Sprocket Rubber"]


def test_plans(spark):
    q = spark.createDataFrame([(1, "how to fix a rust error"), (2, "天气"), (3, "  ")], "query_id long, query string")
    tiers = {}
    for r in planner.plan(q).orderBy("tier_ord", "place").collect():
        tiers.setdefault((r.query_id, r.tier), []).append(r.engine)
    assert tiers[1, "fallback"] == ["bing"] and tiers[2, "fallback"] == ["bing", "baidu", "sogou", "so360"]
    assert tiers[1, "api"] == ["stackexchange", "crates"] and (2, "api") not in tiers and not any(k[0] == 3 for k in tiers)
    keyed = planner.plan(q, Config(keys={"serper": "k", "exa": "k", "tavily": "k"})).filter("tier = 'keyed' and query_id = 1")
    assert sorted(r.engine for r in keyed.collect()) == ["serper", "tavily"]
    asked = spark.createDataFrame([(1, "où est-ce", None), (2, "plain", "zh"), (3, " ", ""), (4, None, None)], "query_id long, query string, language string")
    bound = {r.query_id: (r.language, r.region) for r in planner.options(asked, Config(region="cn")).collect()}
    assert bound[1] == ("fr", "cn") and bound[2][0] == "zh" and bound[3][0] == "en"
    assert {r.language for r in planner.options(asked, Config(language="de")).filter("query_id <> 2").collect()} == {"de"}
    assert sorted(map(tuple, planner.refusals(asked).collect())) == [(3, "none", "empty query"), (4, "none", "empty query")]
    assert planner.plan(asked, engines=("bing", "bing")).filter("query_id = 1").count() == 1
    assert planner.plan(q, engines=("all",)).filter("query_id = 1").count() == 24
    states = {r.engine: r.state for r in planner.available(planner.plan(q, engines=("bing", "exa", "brave", "none")).filter("query_id = 1"), Config(), spark.createDataFrame([("bing",)], "engine string")).collect()}
    assert states == {"bing": "skipped", "exa": "unconfigured", "brave": "usable"}


def test_pages_to_markdown():
    page = html.convert('<html lang="en"><head><title>T</title><meta name="author" content="A"></head><body><nav>menu</nav><article><h1>Head</h1><p>' + "Words of the article, and more. " * 8 + '<a href="/r">rel</a></p><pre><code class="language-py">x = 1\n\ny</code></pre><ul><li>a<li>b</ul><dl><dt>k<dd>v</dl><table><tr><th>x|y<th>z<tr><td>1</table><img src="/pixel.gif" alt="p"><a href="/e"></a></article></body></html>', "https://e.com/d/")
    md = page["markdown"]
    assert page["title"] == "T" and page["byline"] == "A" and page["language"] == "en" and "menu" not in md
    assert "# Head" in md and "[rel](https://e.com/r)" in md and "```py\nx = 1\n\ny\n```" in md and "- a\n- b" in md and "**k**\n: v" in md
    assert "| x\\|y | z |\n| --- | --- |\n| 1 |  |" in md and "pixel" not in md and "[](" not in md
    assert html.convert("")["markdown"] == "" and html.convert(None)["markdown"] == "" and html.convert("<div>" * 5000 + "deep")["markdown"] == "deep"


def test_documents(spark):
    got = {n: office.parse(b, k) for (n, b), k in zip(state.SAMPLES.items(), ("docx", "unknown", "pptx", "odt", "epub", "csv", "json", "text", "unknown", "pdf", "docx"))}
    assert got["a.docx"]["markdown"] == "# Head\n\nHello\n\n| a | b |\n| --- | --- |"
    assert got["a.xlsx"]["kind"] == "xlsx" and got["a.xlsx"]["sheets"] == ["Data"] and "| name |  | value |" in got["a.xlsx"]["markdown"]
    assert got["a.pptx"]["markdown"].index("Slide 2") < got["a.pptx"]["markdown"].index("Slide 10") and got["a.pptx"]["slides"] == 3
    assert got["a.odt"]["markdown"] == "## Head\n\none two three"
    assert got["a.epub"]["markdown"].startswith("# Book") and got["a.epub"]["markdown"].index("First") < got["a.epub"]["markdown"].index("Second")
    assert got["a.csv"]["markdown"].splitlines()[2] == '| Doe; J | said "hi" |' and '"c": null' in got["a.json"]["markdown"]
    assert "Hello" in got["a.pdf"]["markdown"] and "Could not read" in got["broken.docx"]["markdown"]
    assert office.json_shape({"a": [1], "b": {"c": {"d": {"e": 1}}}}) == "{ a: Array(1) of number, b: { c: { d: {…} } } }"
    assert office.delimited("a\tb\n1\t\"x\ny\"\n") == [["a", "b"], ["1", "x\ny"]]
    md = "## Data\n\nx\n## Data2\n\ny"
    assert spark.range(1).select(office.one_sheet(F.lit(md), "Data2").alias("s")).first().s == "## Data2\n\ny"


def test_breaker_fold_equals_state(spark):
    import random

    r = random.Random(3)
    rows = [(f"e{r.randrange(3)}", i // 2, i, r.random() < 0.4, 2, 1.0, r.choice(["HTTP 429", "ECONNREFUSED", "read timeout"])) for i in range(300)]
    df = spark.createDataFrame(rows, "engine string, s long, seq long, ok boolean, results long, latency_ms double, error string").select("engine", F.timestamp_seconds("s").alias("ts"), "seq", "ok", "results", "latency_ms", F.when(~F.col("ok"), F.col("error")).alias("error"))
    for cut in (5, 40, 299):
        part = df.filter(F.col("seq") <= cut)
        assert sorted(map(tuple, breaker.state(part).collect())) == sorted(map(tuple, breaker.replay(part).collect()))
    now = F.timestamp_seconds(F.lit(10_000_000))
    assert breaker.recovered(breaker.state(df), now).filter("consecutive_failures > 0 or benched_until_us > 0").count() == 0


def test_cache(spark):
    table = spark.createDataFrame([("a", 1, "old"), ("b", 2, "x")], "url string, t long, v string").select("url", F.timestamp_seconds("t").alias("fetched_at"), "v")
    new = spark.createDataFrame([("a", 5, "newest"), ("a", 4, "new"), ("c", 3, "y")], "url string, t long, v string").select("url", F.timestamp_seconds("t").alias("fetched_at"), "v")
    after = cache.upsert(table, new, ["url"], "fetched_at")
    assert sorted((r.url, r.v) for r in after.collect()) == [("a", "newest"), ("b", "x"), ("c", "y")]
    now = F.timestamp_seconds(F.lit(6))
    assert cache.hits(after, 2, now).count() == 1 and cache.hits(after, -1, now).count() == 3
    assert [r.url for r in cache.prune(after, now, max_rows=2).orderBy("url").collect()] == ["a", "c"]
    left, gone = cache.clear(after, F.col("url") == "a")
    assert gone == 1 and left.count() == 2


def test_upsert_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    make = lambda rows, n: spark.createDataFrame(rows, "key string, at long").coalesce(1).write.mode("append").parquet(f"{src}/{n}")
    make([("a", 1), ("b", 1)], 0)
    put = breaker.upsert_sink(str(out), ["key"], "at")
    put(spark.read.parquet(f"{src}/0"), 0)
    make([("a", 3), ("a", 2)], 1)
    put(spark.read.parquet(f"{src}/1"), 1)
    assert sorted((r.key, r["at"]) for r in breaker.read_sink(spark, str(out), "key string, at long").collect()) == [("a", 3), ("b", 1)]
    again = breaker.upsert_sink(str(out), ["key"], "at")
    for epoch, rows in enumerate([[("c", 1)], [("c", 2)], [("c", 2)]]):  # a stream that starts anew counts from 0 again
        again(spark.createDataFrame(rows, "key string, at long"), epoch)
    assert sorted((r.key, r["at"]) for r in breaker.read_sink(spark, str(out), "key string, at long").collect()) == [("a", 3), ("b", 1), ("c", 2)]
    assert len(list(out.iterdir())) == 2


def test_engine(spark):
    engine = Engine(spark, now=F.lit("2025-06-15").cast("timestamp"))
    pages = spark.createDataFrame([("https://a.example.com/x", "<title>T</title><article><p>" + "some text here, " * 20 + "</p></article>"), ("http://127.0.0.1/", "<p>x"), ("https://a.example.com/no", "<p>x")], "url string, html string")
    robots = spark.createDataFrame([("a.example.com", [(False, "/no")])], "host string, rules array<struct<allow:boolean,pattern:string>>")
    got = {r.url: r for r in engine.fetch_urls(pages, robots, max_chars=500).collect()}
    assert got["https://a.example.com/x"].title == "T" and got["https://a.example.com/x"].error is None
    assert got["http://127.0.0.1/"].error and got["https://a.example.com/no"].error == "disallowed by robots.txt"
    assert engine.list_engines().count() == 24 and engine.manifest().count() == 8
    assert "| duckduckgo | primary |" in engine.list_engines(breaker.snapshot(engine.list_engines(), breaker.replay(state.attempts(spark, "/root/testdata/sf0.001")), engine.now)).first().markdown
    df = lists(spark, [("duckduckgo", 1.0, [("One title", "https://one.com/a", "s")]), ("mojeek", 1.0, [("One title", "https://one.com/a", "s")])])
    queries = spark.createDataFrame([(1, "words")], "query_id long, query string")
    found = engine.web_search(queries, df)
    assert "1. [One title](https://one.com/a)" in render.search_results(queries, found, engine.now).first().markdown
    read = spark.createDataFrame([("https://one.com/a", "Words that answer. " * 20)], "url string, content string")
    many = spark.createDataFrame([(1, "words"), (500, "words")], "query_id long, query string")
    both = df.unionByName(df.withColumn("query_id", F.lit(500)))
    brief = engine.research(many, both, read, depth=1, max_sources=2)
    assert sorted((r.query_id, r.url, len(r.passages)) for r in brief.collect()) == [(1, "https://one.com/a", 1), (500, "https://one.com/a", 1)]
    assert "> Words that answer." in render.research_brief(many, brief).filter("query_id = 500").collect()[0].markdown
    with pytest.raises(ValueError):
        engine.local_index(pages, "nothing")


def test_snippets_in_following_rows():
    rows = "".join(f"<tr><td><a class='result-link' href='https://r{i}.example.com/'>Result number {i}</a></td></tr><tr><td class='result-snippet'>Snippet {i}</td></tr><tr><td>&nbsp;</td></tr>" for i in range(3))
    from lodestar.sources.payloads import PAGES

    got = html.extracted_results(f"<table>{rows}</table>", "https://lite.example.org/", PAGES["duckduckgo"])
    assert [(r["title"], r["snippet"]) for r in got] == [(f"Result number {i}", f"Snippet {i}") for i in range(3)]


def test_registered_functions(spark):
    from lodestar import session

    assert session.register(spark) == ["html_page", "nfkc", "parse_document", "word_stem"]
    row = spark.sql("select word_stem('running') as s, html_page('<title>T</title><p>x', 'https://a.b/').title as t").first()
    assert (row.s, row.t) == ("run", "T")


ODD_TEXTS = [
    (1, "# Window size 5\nbananana banana ban\n\n- 3. ananas\n" + "word " * 30 + "banana split"),
    (2, "x" * 70 + "banana" + "y" * 70 + "\n\u00c4PFEL banana\u00a0split\nB\u0130g"),
    (3, None), (4, ""), (5, "nothing here\n \t\n"), (6, "aaaaaaa aaaa\n" * 3 + "7. banana aaaa"), (7, "```\nbanana\n```\nafter\n"),
    (8, ("word " * 450 + "banana\n# banana 1\n") * 3 + "banana split. " * 120),
]
ODD_QUERIES = [(0, ["banana", "split"]), (1, ["anan", "window"]), (2, ["aa"]), (3, [""]), (4, ["banana split", "5"]), (5, ["\u00e4pfel", "", "b"]), (6, ["banana", "split"]), (7, []), (8, ["aaaa", "aa", "banana"])]


def _odd(spark):
    docs = spark.createDataFrame(ODD_TEXTS, "doc_id long, content string")
    return docs, spark.createDataFrame(ODD_QUERIES, "query_id int, terms array<string>")


def test_scores_of_many_queries_are_those_of_each_pair(spark):
    docs, queries = _odd(spark)
    docs = docs.withColumn("blocks", passages.blocks(F.col("content"), by_line=True))
    held = docs.join(queries, F.exists("terms", lambda t: (t != "") & F.contains(F.lower("content"), t)))
    each = held.select("doc_id", "query_id", F.transform("blocks", lambda b: text.score_block(b["text"], F.col("terms"))).alias("s")).filter("size(s) > 0")
    want = sorted((r.doc_id, r.query_id, len(r.s), functools.reduce(operator.add, r.s, 0.0), max(r.s)) for r in each.collect())
    got = sorted(tuple(r) for r in passages.score_passages(docs, queries).collect())
    assert got == want and len(got) > 15 and {r[1] for r in got} == {0, 1, 2, 4, 5, 6, 8}


def test_passage_scores_pairs_no_texts_with_queries(spark):
    from lodestar.plans import texts

    plan = texts.passage_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "Generate" not in plan


@pytest.mark.parametrize("most_chars", [900, 60])
def test_passages_of_many_queries_are_those_of_each_pair(spark, most_chars):
    docs, queries = _odd(spark)
    docs = docs.withColumn("content", F.replace("content", F.lit("\n"), F.lit("\n\n"))).withColumn("blocks", passages.blocks(F.col("content")))
    held = docs.join(queries, F.exists("terms", lambda t: (t != "") & F.contains(F.lower("content"), t)))
    want = passages.select_passages(held, most_chars=most_chars, total_chars=1000)
    got = passages.select_asked(docs, queries, most_chars=most_chars, total_chars=1000)
    show = lambda df: sorted((r.doc_id, r.query_id, [tuple(p) for p in r.passages]) for r in df.collect())
    assert got.columns == want.columns and got.schema["passages"].dataType.simpleString() == want.schema["passages"].dataType.simpleString()
    assert show(got) == show(want) and (7, 0) in {(a, b) for a, b, _ in show(got)}


def test_passages_selected_pairs_no_texts_with_queries(spark):
    from lodestar.plans import texts

    plan = texts.passages_selected(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan


@pytest.mark.parametrize("stemmed", [True, False])
def test_a_stored_index_finds_what_a_built_one_finds(spark, stemmed):
    docs = spark.createDataFrame([*DOCS, (6, None, "protocol protocols bean"), (7, "Beans", None), (8, "", "handshake of protocols, cooking by the protocol")], "doc_id long, title string, content string")
    queries = spark.createDataFrame([(1, "proto"), (2, "\u4e0a\u4e0b\u6587"), (3, "protocols handshake"), (4, "CAFE"), (5, ""), (6, "bean"), (7, "proto hand cook"), (8, "\u7a97\u53e3 zzz")], "query_id long, query string")
    found = [sorted(map(tuple, index.search(make(docs, stemmed), queries, stemmed=stemmed).collect())) for make in (index.build, index.stored)]
    assert found[0] == found[1] and {r[0] for r in found[0]} == {1, 2, 3, 4, 6, 7}


def test_a_search_of_a_stored_index_shuffles_no_postings(spark):
    """Words that no clause asks for are gone before anything is dealt out."""
    docs = spark.range(200).selectExpr("id as doc_id", "'title' as title", "concat('needle', id % 2, ' ', array_join(transform(sequence(1, 300), i -> concat('word', id, 'x', i)), ' ')) as content")
    queries = spark.createDataFrame([(1, "needle1 title")], "query_id long, query string")
    built = index.stored(docs, stemmed=False)
    hits = index.clause_hits(built, index.clauses(queries), stemmed=False)
    assert hits.count() == 100 + 200
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(query_id")


def test_search_index_and_bm25_topk_search_a_stored_index(spark, monkeypatch):
    from lodestar.plans import texts

    def refuse(*_, **__):
        raise AssertionError("cuts texts into words for each table of the index")

    monkeypatch.setattr(index, "build", refuse)
    assert texts.bm25_topk(spark, "/root/testdata/sf0.001").count() > 0 and texts.search_index(spark, "/root/testdata/sf0.001").count() > 0
