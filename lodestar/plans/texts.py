"""Queries on texts, the index, passages, research and planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.config import Config
from lodestar.functions import text
from lodestar.operators import cache, fusion, index, passages, planner, research
from lodestar.session import kept
from lodestar.sources import payloads, registry

from .common import TITLE, fused_sql, rankings, table, title_of

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def q(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


STOP = q(text.STOPWORDS)


def tokens_sql(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(lower({c}), '[a-z0-9][a-z0-9''+._-]*'), lambda t: regexp_replace(t, '[._''-]+$', '')), lambda t: (length(t) > 2 or regexp_matches(t, '^[0-9]+$')) and t not in ({STOP}))"


@query("tokenize_counts", f"select doc_id, len(w) as n, len(list_distinct(w)) as terms from (select doc_id, {tokens_sql('text')} as w from documents)")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("terms"))


@query("term_df", f"select term, count(*) as df from (select doc_id, unnest(list_distinct({tokens_sql('text')})) as term from documents) group by 1")
def term_df(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.explode(text.unique_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(
    "top_terms_by_lang",
    f"select lang, term, df, place from (select lang, term, count(*) as df, row_number() over (partition by lang order by count(*) desc, term) as place from (select lang, doc_id, unnest(list_distinct({tokens_sql('text')})) as term from documents) group by 1, 2) where place <= 20",
)
def top_terms_by_lang(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    df = docs.select("lang", F.explode(text.unique_terms(F.col("text"))).alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("df"), "term"))
    return df.withColumn("place", place.cast("long")).filter("place <= 20")


@query("token_estimate", "select conv_id, turn, ceil(length(coalesce(text, '')) / 4)::bigint as tokens, len(regexp_extract_all(coalesce(text, ''), '[^\\s]+')) as words from conversations")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.estimate_tokens(F.col("text")).alias("tokens"), text.count_words(F.col("text")).alias("words"))


@query(
    "guess_language",
    "select doc_id, case when regexp_matches(text, '[àâçéèêëîïôûùüÿœÀÂÇÉÈÊËÎÏÔÛÙÜŸŒ]') then 'fr' when regexp_matches(text, '[äöüßÄÖÜ]') then 'de' when regexp_matches(text, '[áéíóúñ¿¡ÁÉÍÓÚÑ]') then 'es' when regexp_matches(text, '[а-яёА-ЯЁ]') then 'ru' else 'en' end as guess from documents",
)
def guess_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.guess_language(F.col("text")).alias("guess"))


@query(
    "truncate_text",
    """select doc_id, case when length(text) <= 200 then text else rtrim(case when b > 120 then substr(c, 1, b + 1) else c end, ' \t\n\r') || '…' end as short from (
  select doc_id, text, c, greatest(case when contains(c, chr(10) || chr(10)) then length(c) - strpos(reverse(c), chr(10) || chr(10)) - 1 else -1 end, case when contains(c, '. ') then length(c) - strpos(reverse(c), ' .') - 1 else -1 end) as b
  from (select doc_id, text, substr(text, 1, 199) as c from documents))""",
)
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.truncate(F.col("text"), 200).alias("short"))


@query("collapse_spaces", "select doc_id, length(trim(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' ' || chr(10) || chr(9))) as n from documents")
def collapse_spaces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length(text.collapse_spaces(F.col("text"))).cast("long").alias("n"))


@query(
    "sentence_counts",
    r"""with s as (select doc_id, string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ') as w from documents)
select doc_id, case when w = [''] then 0 else 1 + len(list_filter(w[1:len(w) - 1], lambda x: regexp_matches(x, '[.!?。！？；;]$') and not regexp_matches(x, '(?i)(^|[^\p{L}\p{N}_])(e\.g|i\.e|vs|etc|Mr|Ms|Dr|Fig|No|al)\.$'))) end as n from s""",
)
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    """No document has CJK sentences that end without a space."""
    return table(spark, d, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Two words of each benchmark item as a query."""
    items = table(spark, d, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.filter(text.unique_terms(F.col("text")), lambda t: F.length(t) >= 6), 1, 2), " ").alias("query"))


ASKED = f"""bt as (select item_id, {tokens_sql('text')} as ws from benchmark),
bu as (select item_id, unnest(ws) as t, unnest(range(1, len(ws) + 1)) as i from bt),
bd as (select item_id, t, min(i) as i from bu where length(t) >= 6 group by 1, 2),
asked as (select item_id as query_id, t as term from (select *, row_number() over (partition by item_id order by i) as n from bd) where n <= 2)"""


@query("memory_search", f"with {ASKED} select query_id, doc_id, count(*) as score from asked join documents on contains(lower(lang || ' ' || text), term) group by 1, 2")
def memory_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("title"), F.col("text").alias("content"))
    return cache.count_terms(docs, asked(spark, d).select("query_id", F.split("query", " ").alias("terms")))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their first lines as titles."""
    return table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), F.col("source").alias("domain"))


# the letters that lose their marks, as in the four languages of the documents; the pattern's classes agree on them
_WORDS = "regexp_extract_all(strip_accents(lower({0})), '[\\p{{L}}\\p{{N}}]+')"
INDEX = f"""t as (select doc_id, {_WORDS.format("split_part(text, chr(10), 1)")} as tw, {_WORDS.format("split_part(text, chr(10), 1) || chr(10) || text")} as bw from documents),
o as (select doc_id, 4.0 as wt, unnest(tw) as term from t union all select doc_id, 1.0, unnest(bw) from t),
dl as (select doc_id, len(tw) + len(bw) as dl from t),
st as (select count(*) as n, avg(dl) as avg from dl)"""


@query("postings_stats", f"with {INDEX} select term, count(*) as tf, count(distinct doc_id) as df from o where wt = 1.0 group by 1")
def postings_stats(spark: SparkSession, d: str) -> DataFrame:
    built = index.build(corpus(spark, d), stemmed=False)
    return built.postings.filter("col = 'body'").groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


@query(
    "bm25_topk",
    f"""with {ASKED}, {INDEX}, q as (select query_id, term as p from (select query_id, strip_accents(term) as term from asked)),
h as (select query_id, p, doc_id, sum(wt) as f from q join o on starts_with(o.term, q.p) group by 1, 2, 3),
df as (select query_id, p, count(*) as df from h group by 1, 2),
s as (select h.query_id, h.doc_id, count(*) as m, sum(greatest(ln((n - df.df + 0.5) / (df.df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * dl / avg))) as score from h join df on h.query_id = df.query_id and h.p = df.p join dl on h.doc_id = dl.doc_id, st group by 1, 2)
select query_id, doc_id, score, pos from (select s.query_id, doc_id, score, row_number() over (partition by s.query_id order by score desc, doc_id) as pos from (select query_id, doc_id, m, round(round(score, 5 - floor(log10(score))::int), 4) as score from s) s join (select query_id, count(*) as need from q group by 1) w on s.query_id = w.query_id and s.m = w.need) where pos <= 10""",
)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Search without stemming, which SQL can follow; ties in four decimals go by document."""
    scored = index.bm25(index.stored(corpus(spark, d), stemmed=False), asked(spark, d), stemmed=False).withColumn("score", F.round("score", 4))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("pos", place.cast("long")).filter("pos <= 10")


@query("search_index")
def search_index(spark: SparkSession, d: str) -> DataFrame:
    """Stemmed search with highlighted snippets."""
    docs, queries = corpus(spark, d), asked(spark, d)
    # few rows of known size: they go to the documents, not the documents to them
    top = kept(index.search(index.stored(docs), queries, k=5), "top")
    return index.highlight(top.join(docs, "doc_id").join(queries, "query_id")).select("query_id", "doc_id", "pos", "score", "snippet")


@query("match_expression", f"""with {ASKED} select query_id, string_agg('"' || term || '"*', ' AND ' order by i) as expression from (select query_id, term, row_number() over () as i from asked) group by 1""")
def match_expression(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).select("query_id", index.match_expression(F.col("query")).alias("expression"))


@query("phrase_match")
def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    """CJK rows, of which the tables have none: phrases of character pairs."""
    docs = spark.createDataFrame([(1, "窗口", "上下文窗口很重要"), (2, "other", "context window"), (3, "上文", "下文和上文"), (4, "字", "文")], "doc_id long, title string, content string")
    queries = spark.createDataFrame([(1, "上下文"), (2, "window"), (3, "文"), (4, "窗口 context")], "query_id long, query string")
    return index.search(index.build(docs), queries)


def _holding(spark: SparkSession, d: str, **more: Column) -> DataFrame:
    """Every query with every document that holds one of its terms, as the scores count them: anywhere in the lower-cased text. ``more`` are columns made of each document once."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), F.lower("text").alias("low")).withColumns(more)
    queries = asked(spark, d).select("query_id", F.split("query", " ").alias("terms"))
    return docs.join(F.broadcast(queries), F.exists("terms", lambda t: (t != "") & F.contains("low", t))).drop("low")


@query(
    "passage_scores",
    f"""with {ASKED}, fq as (select query_id, list(term order by i) as terms from (select query_id, term, row_number() over () as i from asked) group by 1),
ld as (select doc_id, text, lower(text) as low from documents), hold as (select doc_id, query_id, terms, text from ld join fq on len(list_filter(terms, lambda t: contains(low, t))) > 0),
b as (select doc_id, query_id, terms, unnest(string_split(text, chr(10))) as line from hold),
l as (select doc_id, query_id, trim(line) as b, lower(trim(line)) as low, terms from b where trim(line) <> ''),
c as (select *, greatest(len(regexp_split_to_array(low, '\\s+')), 1) as words, list_transform(terms, lambda t: least((length(low) - length(replace(low, t, ''))) // length(t), 6)) as hits from l),
s as (select *, (len(list_filter(hits, lambda x: x > 0)) / len(terms) * 3.2 + least(list_sum(hits) / sqrt(words), 3.0) * 0.5 + case when regexp_matches(b, '^#{{1,6}}\\s') then 0.7 else 0 end + case when regexp_matches(b, '^(\\s*[-*+]|\\s*[0-9]+\\.)\\s') then 0.25 else 0 end + case when regexp_matches(b, '[0-9]') then 0.15 else 0 end)
  * least(1.0, words / 25) * case when words > 400 then 0.6 else 1.0 end + case when length(array_to_string(terms, ' ')) > 8 and contains(low, array_to_string(terms, ' ')) then 1.6 else 0 end as score from c)
select doc_id, query_id, count(*) as blocks, round(sum(score), 3) as total, round(max(score), 3) as best from s group by 1, 2""",
)
def passage_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every query's scores of the lines of every document that holds one of its terms; each line is read once for all queries."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.struct(F.trim(x).alias("text"))), lambda x: x["text"] != "")
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), lines.alias("blocks"))
    scored = passages.score_passages(docs, asked(spark, d).select("query_id", F.split("query", " ").alias("terms")))
    return scored.select("doc_id", "query_id", "blocks", F.round("total", 3).alias("total"), F.round("best", 3).alias("best"))


@query("passages_selected")
def passages_selected(spark: SparkSession, d: str) -> DataFrame:
    """Each document is cut into blocks once, however many queries ask it, and each block is read once for all queries."""
    content = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    docs = table(spark, d, "documents").select("doc_id", content.alias("content")).withColumn("blocks", passages.blocks(F.col("content")))
    return passages.select_asked(docs, asked(spark, d).select("query_id", F.split("query", " ").alias("terms")))


@query(
    "snippets",
    f"""with {ASKED}, fq as (select query_id, list(term order by i) as terms from (select query_id, term, row_number() over () as i from asked) group by 1),
ld as (select doc_id, lower(text) as low, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[ \\t]+', ' ', 'g'), ' ' || chr(10) || chr(9) || chr(13)) as c from documents),
h as (select doc_id, query_id, c, list_min(list_filter(list_transform(terms, lambda t: strpos(lower(c), t)), lambda i: i > 0)) as best from ld join fq on len(list_filter(terms, lambda t: contains(low, t))) > 0),
w as (select *, greatest(0, best - 1 - 112) as start, substr(c, 1, 319) as cut from h),
e as (select *, greatest(case when contains(cut, chr(10) || chr(10)) then length(cut) - strpos(reverse(cut), chr(10) || chr(10)) - 1 else -1 end, case when contains(cut, '. ') then length(cut) - strpos(reverse(cut), ' .') - 1 else -1 end) as stop from w)
select doc_id, query_id, case when length(c) <= 320 then c when best is null then rtrim(case when stop > 192 then substr(cut, 1, stop + 1) else cut end, ' ' || chr(9) || chr(10) || chr(13)) || '…'
  else case when start > 0 then '…' else '' end || trim(substr(c, start + 1, 320)) || case when start + 320 < length(c) then '…' else '' end end as snippet from e""",
)
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return _holding(spark, d).select("doc_id", "query_id", text.make_snippet(F.col("content"), F.col("terms")).alias("snippet"))


def topics(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Questions on the topics of the page rankings, and their fused results."""
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "best_rank", "seq"))
    found = fusion.fuse(rankings(spark, d)).withColumn("pos", pos).filter("pos <= 12")
    queries = found.select("query_id").distinct().withColumn("query", F.concat(F.lit("topic"), F.col("query_id").cast("string")))
    return queries, found


_TOPICS = f"{fused_sql()}, o as (select *, row_number() over (partition by query_id order by score desc, best_rank, seq) as p from f), top as (select * from o where p <= 12)"


@query(
    "query_expansion",
    f"""with {_TOPICS}, k as (select query_id, p, unnest(list_distinct({tokens_sql("title || ' ' || snippet")})) as term from top), nr as (select query_id, count(*) as n from top group by 1),
d as (select query_id, term, count(*) as df from k where term <> 'topic' || query_id and length(term) >= 3 and not regexp_matches(term, '^[0-9]+$') group by 1, 2)
select d.query_id, term, df, row_number() over (partition by d.query_id order by df desc, term) as place from d join nr on d.query_id = nr.query_id where df >= 2 and df <= greatest(3, ceil(n * 0.8))""",
)
def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    return research.expansion_terms(*topics(spark, d)).select("query_id", "term", F.col("df").cast("long").alias("df"), F.col("place").cast("long").alias("place"))


@query(
    "choose_sources",
    f"""with {_TOPICS}, v as (select *, score + (len(list_distinct(engine_list)) - 1) * 0.05 as v from top), w as (select *, row_number() over (partition by query_id, source order by v desc, seq) > 1 as late from v)
select query_id, url, pos from (select query_id, url, row_number() over (partition by query_id order by late, v desc, seq) as pos from w) where pos <= 4""",
)
def choose_sources(spark: SparkSession, d: str) -> DataFrame:
    return research.choose_sources(topics(spark, d)[1], 4).select("query_id", "url", F.col("pos").cast("long").alias("pos"))


@query(
    "absorb_queries",
    f"with {_TOPICS}, a as (select query_id // 5 as root, query_id % 5 as so, * exclude (query_id) from top) select root as query_id, url, max(score) as score, arg_max(snippet, length(snippet) * 1000000000 - so * 1000000 - p) as snippet, arg_min(title, so * 1000000 + p) as title from a group by 1, 2",
)
def absorb_queries(spark: SparkSession, d: str) -> DataFrame:
    _, found = topics(spark, d)
    both = found.withColumn("search_ord", F.col("query_id") % 5).withColumn("query_id", F.expr("query_id div 5"))
    return research.absorb(both).select("query_id", "url", "score", "snippet", "title")


@query("research_brief")
def research_brief(spark: SparkSession, d: str) -> DataFrame:
    """Questions answered from the pages' texts by passages of chosen sources."""
    from lodestar.functions import url

    queries, found = topics(spark, d)
    pages = url.with_url(table(spark, d, "pages"), "url", "u").select(F.col("u.key").alias("url"), text.html_to_text(F.col("html")).alias("content"))
    named = found.groupBy("query_id").agg(F.min_by("title", "pos").alias("query"))

    def search(wanted: DataFrame) -> DataFrame:
        return found.withColumnRenamed("query_id", "root").join(wanted.select("query_id", "root"), "root").drop("root")

    return research.research(named, search, pages, depth=2, max_sources=4).select("query_id", "pos", "url", "title", "score", "passages")


@query("engine_catalogue", "select * from (values " + ", ".join(f"({q([e])}, {i}, {q([t])}, {w}::double, {str(e in registry.KEYLESS).lower()})" for i, (e, t, w, _, _) in enumerate(registry.ENGINES)) + ") v(engine, engine_ord, tier, weight, configured)")
def engine_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return registry.catalogue(spark, Config()).select("engine", "engine_ord", "tier", "weight", "configured")


def _plan_sql() -> str:
    rows = [("primary", 1, e, i, None) for i, e in enumerate(Config().primary_engines)]
    rows += [("fallback", 2, e, i, None) for i, e in enumerate(Config().fallback_engines) if e == "bing"]
    rows += [("api", 3, e[0], i, e[4]) for i, e in enumerate(x for x in registry.ENGINES if x[4])]
    values = ", ".join(f"('{t}', {o}, '{e}', {i}, {'null' if r is None else q([r])})" for t, o, e, i, r in rows)
    return f"select conv_id, turn, tier, engine, place from conversations, (values {values}) v(tier, tier_ord, engine, place, rx) where role = 'user' and trim(text) <> '' and (rx is null or regexp_matches(text, rx, 'i'))"


@query("tier_plan", _plan_sql())
def tier_plan(spark: SparkSession, d: str) -> DataFrame:
    """The plan of every user's turn; no turn has CJK text."""
    said = table(spark, d, "conversations").filter("role = 'user'").select(F.struct("conv_id", "turn").alias("query_id"), F.col("text").alias("query"))
    return planner.plan(said).select("query_id.conv_id", "query_id.turn", "tier", "engine", "place")


@query(
    "tier_prefix_stop",
    f"""with {fused_sql()}, e as (select query_id, key, min(engine_ord) as t from r group by 1, 2), n as (select query_id, t, count(*) as n from e group by 1, 2),
tiers as (select distinct query_id, engine_ord as t, engine from r), b as (select tiers.query_id, tiers.t, tiers.engine, coalesce(sum(n) over (partition by tiers.query_id order by tiers.t rows between unbounded preceding and 1 preceding), 0) as before from tiers left join n on n.query_id = tiers.query_id and n.t = tiers.t)
select query_id, engine from b where least(before, 20) < 10""",
)
def tier_prefix_stop(spark: SparkSession, d: str) -> DataFrame:
    """Each list is a tier; the next one runs while fewer than ten pages are found."""
    rows = rankings(spark, d)
    planned = rows.select("query_id", "engine", F.col("engine_ord").alias("tier_ord")).distinct()
    return planner.tier_prefix(planned, rows, limit=10).select("query_id", "engine").distinct()


@query("web_search")
def web_search(spark: SparkSession, d: str) -> DataFrame:
    """The whole search: the lists stand for three sources of two tiers."""
    rows = rankings(spark, d).withColumn("engine", F.when(F.col("engine") == "a", "duckduckgo").when(F.col("engine") == "b", "mojeek").otherwise("bing"))
    queries = rows.select("query_id").distinct().withColumn("query", F.lit("words"))
    return planner.search(queries, rows, 10).select("query_id", "pos", "url", "title", "engines", "score")


@query("html_title_lang", f"select page_id, {TITLE} as title, regexp_extract(html, '<html[^>]*lang=\"([^\"]*)\"', 1) as lang from pages")
def html_title_lang(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", title_of().alias("title"), F.regexp_extract("html", r'<html[^>]*lang="([^"]*)"', 1).alias("lang"))


def _text_sql() -> str:
    """The text of pages whose entities are written in lower case."""
    out = "regexp_replace(html, '<!--.*?-->', ' ', 'gs')"
    for tag in ("script", "style", "noscript", "template"):
        out = f"regexp_replace({out}, '<{tag}\\b.*?</{tag}\\s*>', ' ', 'gis')"
    out = f"regexp_replace({out}, '<br\\s*/?>|</(p|div|li|tr|h[1-6]|section|article|blockquote|pre|ul|ol|table)\\s*>', chr(10), 'gi')"
    out = f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    for name, char in [*list(text.ENTITIES.items())[1:], ("amp", "&")]:
        out = f"replace({out}, '&{name};', {q([char])})"
    out = f"regexp_replace(regexp_replace({out}, '[ \\t]+', ' ', 'g'), '\\r\\n?', chr(10), 'g')"
    return f"regexp_replace(regexp_replace(regexp_replace({out}, '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query("html_to_text", f"select page_id, {_text_sql()} as text from pages")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query("page_slice", "select doc_id, substr(text, 101, 300) as part, length(text) > 400 as truncated, case when length(text) > 400 then 400 end as next_offset from documents")
def page_slice(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.sliced(F.col("text"), 100, 300).alias("s")).select("doc_id", "s.part", "s.truncated", "s.next_offset")


@query("abstract_rebuild", "select doc_id, array_to_string(list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: x <> ''), ' ') as text from documents")
def abstract_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Each text as an inverted index (word to places) and back."""
    words = table(spark, d, "documents").select("doc_id", F.posexplode(F.filter(F.split(F.regexp_replace("text", r"\s+", " "), " "), lambda x: x != "")).alias("at", "word"))
    inverted = words.groupBy("doc_id", "word").agg(F.collect_list("at").alias("places")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("index"))
    return inverted.select("doc_id", payloads.inverted_text(F.col("index")).alias("text"))
