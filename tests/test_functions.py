"""Functions against worked examples."""

import pytest
from pyspark.sql import functions as F

from lodestar import config
from lodestar.functions import fold, policy, text, url
from lodestar.operators import passages

NORMAL = [
    ("https://WWW.Example.com/a/?utm_source=news&b=2&a=1&fbclid=xyz#section", "https://example.com/a?a=1&b=2"),
    ("example.com/index.html", "https://example.com/"),
    ("//x.co.uk:443/a/../b/./c//", "https://x.co.uk/b/c"),
    ("http://a.b:80/x%20y", "http://a.b/x y"),
    ("http://a.b:8080/x?q=&z=", "http://a.b:8080/x?q="),
    ("https://a.b/%E4%B8%AD/?q=a+b&q=c%2Fd", "https://a.b/中?q=a%20b&q=c%2Fd"),
    ("https://u:p@a.b?x=1", "https://a.b/?x=1"),
    ("https://a.b/100%", "https://a.b/100%"),
    ("ftp://a.b/c", None), ("localhost/x", None), ("mailto:x@y.z", None), ("", None), (None, None),
]


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first().x


def test_normalised_addresses(spark):
    df = url.with_url(spark.createDataFrame([(i, a) for i, (a, _) in enumerate(NORMAL)], "i int, url string"))
    assert [r.u.key if r.u else None for r in df.orderBy("i").collect()] == [k for _, k in NORMAL]


def test_domains(spark):
    hosts = {"a.b.example.com": "example.com", "x.co.uk": "x.co.uk", "y.x.co.uk": "x.co.uk", "me.github.io": "me.github.io", "example": "example", "www.q.org": "q.org"}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert {r.h: r.d for r in df.select("h", url.registrable_domain(F.col("h")).alias("d")).collect()} == hosts


def test_redirects(spark):
    u = lambda f, v: one(spark, f(F.col("v")), v=v)
    assert u(url.unwrap_redirect, "//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.b%2Fc%3Fd%3D1&rut=x") == "https://a.b/c?d=1"
    assert u(url.unwrap_redirect, "https://a.b/?page=2") == "https://a.b/?page=2"
    assert u(url.wrapper_target, "https://www.bing.com/ck/a?!&p=1&u=a1aHR0cHM6Ly9hLmIvYw") == "https://a.b/c"
    assert u(url.wrapper_target, "https://a.b/?u=notbase64") is None
    assert [u(lambda c: url.absolute_url(c, F.lit("https://a.b/c/d?x")), h) for h in ("e", "/e", "//f.g/h", "?y", "#z", "javascript:x", "https://q.r")] == ["https://a.b/c/e", "https://a.b/e", "https://f.g/h", "https://a.b/c/d?y", None, None, "https://q.r"]


def test_tokens_and_counts(spark):
    t = lambda f, v: one(spark, f(F.col("v")), v=v)
    assert t(text.tokens, "The C++ and node.js, 42 of it's 上下文 x") == ["c++", "node.js", "42", "it's", "上下", "下文"]
    assert t(text.estimate_tokens, "上下文 abcd") == 4 and t(text.count_words, "two words 上下文") == 4
    assert t(lambda c: text.truncate(c, 10), "abcdefg. hijk") == "abcdefg.…" and t(lambda c: text.truncate(c, 5), "abc") == "abc"
    assert t(text.sentences, "See e.g. this. And that! 好。 End") == ["See e.g. this.", "And that!", "好。", "End"]
    assert t(text.guess_language, "こんにちは") == "ja" and t(text.guess_language, "straße") == "de" and t(text.guess_language, "plain") == "en"
    assert t(text.expand_for_index, "a 上下文 b") == "a 上下文 上下 下文 b" and t(text.column_index, "AB") == 27
    assert t(text.decode_entities, "a &lt;b&gt; &amp;amp; &#233;&#x4e2d; &nope;") == "a <b> &amp; é中 &nope;"
    assert t(text.decode_entities, "&eacute;&UUML; &plusmn;&szlig; &#128512;&#X1F600; &#38;lt; &amp;#65; &#0; &#xD800; &#99999999; so&shy;ft") == "é" "ü ±ß 😀😀 &lt; &#65; &#0; &#xD800; &#99999999; soft"
    assert t(text.clean_snippet, "<b>Result</b>: · Hello   world | ") == "Hello world"
    assert t(text.markdown_links, "[a](https://x.y/1) ![i](https://i.j) [b](https://x.y/1) [c](/no)")[0].text == "a"
    assert t(text.escape_like, "50%_\\") == "50\\%\\_\\\\"
    assert t(text.html_to_text, "<p>a<br>b</p><script>x</script>c").split() == ["a", "b", "c"]


def test_jaccard(spark):
    a, b = text.shingles(F.lit("one two three four")), text.shingles(F.lit("two three four five"))
    assert spark.range(1).select(text.jaccard(a, b).alias("j")).first().j == pytest.approx(1 / 3)


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "adjustable": "adjust", "protocol": "protocol", "sky": "sky", "controlling": "control", "agreed": "agre"}
    assert {w: fold.porter(w) for w in pairs} == pairs


def test_blocks_keep_offsets():
    doc = "# Title\n\nintro line\nmore\n\n```js\ncode\n\nmore code\n```\n\nclosing"
    found = passages.split_blocks(doc)
    assert [t for t, _ in found] == ["# Title", "intro line\nmore", "closing"] and all(doc[o : o + len(t)] == t for t, o in found)


def test_robots(spark):
    said = "User-agent: *\nDisallow: /docs\nAllow: /docs/public\nDisallow: /*.gif$\n\nUser-agent: Lodestar\nUser-agent: other\nDisallow: /private # no\nCrawl-delay: 99\nDisallow:"
    star, own = policy.robots_for(said), policy.robots_for(said, "lodestar")
    assert own == {"rules": [{"allow": False, "pattern": "/private"}, {"allow": False, "pattern": ""}], "delay_ms": 30000}
    df = spark.createDataFrame([(star["rules"], p) for p in ("/docs/x", "/docs/public/y", "/a.gif", "/a.gif?x", "/")], "rules array<struct<allow:boolean,pattern:string>>, path string")
    assert [r.a for r in df.select(policy.path_allowed(F.col("rules"), F.col("path")).alias("a")).collect()] == [False, True, False, True, True]
    assert policy.robots_for(None)["rules"] == []


def test_numeric_addresses(spark):
    hosts = {"2130706433": "127.0.0.1", "0x7f.1": "127.0.0.1", "0177.0.0.01": "127.0.0.1", "10.1": "10.0.0.1", "0x7f000001": "127.0.0.1", "1.2.3.4": "1.2.3.4", "256.1.1.1": "256.1.1.1", "1.2.3.4.5": "1.2.3.4.5", "09.1.1.1": "09.1.1.1", "4294967296": "4294967296", "a.1": "a.1", "x.com": "x.com"}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    found = {r.h: r.d for r in df.select("h", url.dotted(F.col("h")).alias("d")).collect()}
    assert {h: d for h, d in found.items() if h != "09.1.1.1"} == {h: d for h, d in hosts.items() if h != "09.1.1.1"}
    refused = df.limit(2).select(url.fetch_refusal(F.concat(F.lit("http://"), "h", F.lit("/x"))).alias("r")).collect()
    assert [r.r for r in refused] == ["private/loopback address"] * 2


def test_private_hosts(spark):
    hosts = {"localhost": True, "127.0.0.1": True, "10.1.2.3": True, "172.15.0.1": False, "172.31.0.1": True, "[::1]": True, "fd00:1::": True, "8.8.8.8": False, "x.internal": True, "example.com": False}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert {r.h: r.p for r in df.select("h", url.is_private_host(F.col("h")).alias("p")).collect()} == hosts


def test_config_layers(tmp_path):
    file = tmp_path / "c.json"
    file.write_text('{"rrf_k": 10, "max_results": 3, "keys": {"exa": "abcdefghijkl"}}')
    c = config.load_config(str(file), "LODESTAR_RRF_K=20 # x\nexport LODESTAR_AUTO_ENGINES='no'", {"LODESTAR_RRF_K": "30", "LODESTAR_MAX_RESULTS": "x"}, per_engine=4)
    assert (c.rrf_k, c.max_results, c.auto_engines, c.per_engine) == (30, 3, False, 4)
    assert config.redact(c)["keys"] == {"exa": "abcd…kl (12 chars)"}
