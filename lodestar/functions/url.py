"""URL functions.

``with_url`` parses and normalises in staged projections, so that no subexpression is repeated and
all of it stays in generated code. Out of scope: international host names and numeric spellings of IPv4 hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query parameters that never change the page, lower case.
TRACKING = (
    "_hsenc", "_hsmi", "campaign_id", "cid", "cmpid", "dclid", "fbclid", "from_source", "gclid", "gclsrc", "hsctatracking",
    "igshid", "mc_cid", "mc_eid", "mkt_tok", "msclkid", "ncid", "oly_anon_id", "oly_enc_id", "partner", "rb_clickid", "ref",
    "ref_src", "ref_url", "referrer", "s_cid", "sc_campaign", "sc_channel", "sc_content", "sc_country", "sc_geo", "sc_medium",
    "sc_outcome", "scm", "share_source", "si", "smid", "source", "spm", "trk", "trkcampaign", "twclid", "utm_brand",
    "utm_campaign", "utm_content", "utm_id", "utm_medium", "utm_name", "utm_reader", "utm_social", "utm_social-type",
    "utm_source", "utm_term", "vero_conv", "vero_id", "wickedid", "wt_mc", "yclid",
)
# Parameters that are kept even when empty.
KEEP = ("article", "hl", "id", "lang", "p", "page", "q", "s", "t", "v")
# Suffixes of two labels under which names are registered.
SUFFIXES = (
    "ac.cn", "ac.il", "ac.jp", "ac.uk", "blogspot.com", "co.at", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za",
    "com.ar", "com.au", "com.br", "com.cn", "com.eg", "com.hk", "com.mx", "com.my", "com.ph", "com.pk", "com.pl", "com.ru", "com.sa",
    "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "edu.hk", "edu.sg", "github.io", "gitlab.io", "go.jp", "gov.au",
    "gov.cn", "gov.hk", "gov.in", "gov.sg", "gov.uk", "govt.nz", "herokuapp.com", "me.uk", "medium.com", "ne.jp", "ne.kr", "net.au",
    "net.cn", "net.in", "net.nz", "net.uk", "netlify.app", "or.at", "or.id", "or.jp", "or.kr", "org.au", "org.cn", "org.il", "org.in",
    "org.nz", "org.uk", "org.za", "pages.dev", "readthedocs.io", "s3.amazonaws.com", "sch.uk", "substack.com", "vercel.app", "web.id",
    "wordpress.com", "workers.dev",
)
# Hosts that wrap targets in redirects.
WRAPPER_HOSTS = ("baidu.com", "bing.com", "cn.bing.com", "duckduckgo.com", "google.com", "html.duckduckgo.com", "lite.duckduckgo.com", "so.com", "sogou.com", "yandex.com", "yandex.ru")
# Parameters that carry a target, in order of preference, plain and encoded.
PASS_PARAMS = ("uddg", "url", "u", "q", "target", "to", "redirect", "redirect_url", "r", "link")
CARRY_PARAMS = ("u", "url", "uddg", "target", "to", "redirect", "redirect_url", "link", "r", "q")

_QUOTE = {"%3B": ";", "%2C": ",", "%2F": "/", "%3F": "?", "%3A": ":", "%40": "@", "%26": "&", "%3D": "=", "%2B": "+", "%24": "$", "%21": "!", "%7E": "~", "%27": "'", "%28": "(", "%29": ")", "%23": "#"}


def sql_list(values: tuple[str, ...]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def encode_uri(c: Column) -> Column:
    """Percent-encode all but the characters that may stand in a whole URI."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in _QUOTE.items():
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def decode_percent(c: Column) -> Column:
    """Percent-decode, leaving plus signs alone; null if malformed."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def registrable_domain(host: Column) -> Column:
    """The last two labels of a host, or three below a known suffix."""
    labels = F.split(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\.")
    two, three = F.array_join(F.slice(labels, -2, 2), "."), F.array_join(F.slice(labels, -3, 3), ".")
    return F.when(F.size(labels) <= 2, F.array_join(labels, ".")).when(two.isin(*SUFFIXES), three).otherwise(two)


def dotted(host: Column) -> Column:
    """A numeric IPv4 address (one to four decimal, octal or hexadecimal numbers, the last of which fills what is left) in four decimal parts; other hosts as they are."""
    parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.", -1)
    value = lambda x: F.when(x.rlike("^0x"), F.conv(F.concat(F.lit("0"), F.substr(x, F.lit(3))), 16, 10)).when(x.rlike("^0[0-7]+$"), F.conv(x, 8, 10)).otherwise(x).try_cast("decimal(20,0)").try_cast("long")
    numbers = F.transform(parts, value)
    last, n = F.element_at(numbers, -1), F.size(numbers)
    whole = F.aggregate(F.slice(numbers, 1, n - 1), F.lit(0).cast("long"), lambda a, x: a * 256 + x) * F.pow(F.lit(256.0), F.lit(5) - n).cast("long") + last
    right = F.forall(numbers, lambda x: x.isNotNull()) & F.forall(F.slice(numbers, 1, n - 1), lambda x: x < 256) & (last < F.pow(F.lit(256.0), F.lit(5) - n))
    said = F.concat_ws(".", *[F.shiftright(whole, k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0)])
    return F.when(host.rlike(r"^(0x[0-9a-f]*|[0-9]+)(\.(0x[0-9a-f]*|[0-9]+)){0,3}\.?$") & right, said).otherwise(host)


def bound(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the column evaluated once: later filters and projections on it don't copy its expression down the plan."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(F.col(f"`{name}`"))).alias(name))


def with_url(df: DataFrame, source: str = "url", into: str = "u") -> DataFrame:
    """``df`` with a struct ``into``: key, host, domain, path, scheme; null where ``source`` is no web address with a dotted host."""
    kept = df.columns
    full = (
        F.when(F.col("_raw").rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.col("_raw")).when(F.startswith("_raw", F.lit("//")), F.concat(F.lit("https:"), "_raw")).otherwise(F.concat(F.lit("https://"), "_raw"))
    )
    s1 = df.withColumn("_raw", F.trim(F.coalesce(F.col(source), F.lit("")))).withColumn("_full", full)
    s2 = s1.withColumn("_scheme", F.lower(F.regexp_extract("_full", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))).withColumn("_rest", F.regexp_replace(F.substring_index("_full", "#", 1), r"^[A-Za-z][A-Za-z0-9+.-]*:[/\\]*", ""))
    s3 = s2.withColumn("_way", F.replace(F.substring_index("_rest", "?", 1), F.lit("\\"), F.lit("/"))).withColumn("_query", F.when(F.instr("_rest", "?") > 0, F.expr("substr(_rest, instr(_rest, '?') + 1)")).otherwise(F.lit("")))
    s4 = s3.withColumn("_auth", F.regexp_replace(F.substring_index("_way", "/", 1), "^.*@", "")).withColumn("_path0", F.expr("substr(_way, length(substring_index(_way, '/', 1)) + 1)"))
    host = F.regexp_replace(F.lower(F.regexp_replace("_auth", ":[0-9]*$", "")), r"^www\.", "")
    s5 = s4.withColumn("_host", dotted(host)).withColumn("_port", F.regexp_replace(F.regexp_extract("_auth", ":([0-9]+)$", 1), "^0+(?=[0-9])", ""))
    walked = F.expr(
        "aggregate(split(_path0, '/', -1), array(''), (a, x) -> CASE WHEN x IN ('.', '%2e', '%2E') THEN a WHEN x = '..' THEN slice(a, 1, greatest(size(a) - 1, 1)) ELSE concat(a, array(x)) END)"
    )
    # a path of segments: the leading empty one comes from the seed
    plain = F.when(F.col("_path0").rlike(r"/\.{1,2}(/|$)|%2[eE]"), F.concat(F.lit("/"), F.array_join(F.filter(F.slice(walked, 2, 1_000_000), lambda x: x != ""), "/"), F.when(F.col("_path0").rlike(r"/(\.{1,2}/?)?$"), F.lit("/")).otherwise(F.lit("")))).otherwise(F.when(F.col("_path0") == "", F.lit("/")).otherwise(F.col("_path0")))
    s6 = s5.withColumn("_path1", F.regexp_replace(plain, r"(?i)/index\.(html?|php|aspx?)$", "/")).withColumn("_plain", decode_percent(F.col("_path1")))
    safe = F.when(~F.contains("_path1", F.lit("%")), F.col("_path1")).when(encode_uri(F.col("_plain")) == F.col("_path1"), F.col("_plain")).otherwise(F.col("_path1"))
    s7 = s6.withColumn("_path2", safe).withColumn("_path", F.expr("CASE WHEN _path2 RLIKE '^/+$' THEN '/' ELSE regexp_replace(_path2, '/+$', '') END"))
    pairs = F.expr(
        f"""filter(transform(filter(split(_query, '&'), x -> x <> ''), (x, i) -> named_struct(
            'k', coalesce(try_url_decode(substring_index(x, '=', 1)), substring_index(x, '=', 1)), 'i', i,
            'v', CASE WHEN instr(x, '=') > 0 THEN coalesce(try_url_decode(substr(x, instr(x, '=') + 1)), substr(x, instr(x, '=') + 1)) ELSE '' END)),
          p -> array_contains({sql_list(KEEP)}, lower(p.k)) OR (p.v <> '' AND NOT array_contains({sql_list(TRACKING)}, lower(p.k))))"""
    )
    # structs sort by name, then by place, which keeps the order of repeated names
    s8 = s7.withColumn("_pairs", F.array_sort(pairs)).withColumn("_q", F.expr("replace(array_join(transform(_pairs, p -> concat(url_encode(p.k), '=', url_encode(p.v))), '&'), '+', '%20')"))
    port = F.when((F.col("_port") == "") | ((F.col("_scheme") == "http") & (F.col("_port") == "80")) | ((F.col("_scheme") == "https") & (F.col("_port") == "443")), F.lit("")).otherwise(F.concat(F.lit(":"), "_port"))
    key = F.concat("_scheme", F.lit("://"), "_host", port, "_path", F.when(F.col("_q") != "", F.concat(F.lit("?"), "_q")).otherwise(F.lit("")))
    valid = (F.col("_raw") != "") & F.col("_scheme").isin("http", "https") & F.col("_host").rlike(r"^[^\s<>\[\]^|%/?#@:]*\.[^\s<>\[\]^|%/?#@:]*$")
    made = F.when(valid, F.struct(key.alias("key"), F.col("_host").alias("host"), registrable_domain(F.col("_host")).alias("domain"), F.col("_path").alias("path"), F.col("_scheme").alias("scheme")))
    return bound(s8.select(*[F.col(f"`{c}`") for c in kept if c != into], made.alias(into)), into)


def host_matches(host: Column, wanted: Column) -> Column:
    """Whether a host is the wanted one or below it; an empty one matches nothing."""
    h = F.regexp_replace(F.lower(host), r"^www\.", "")
    f = F.regexp_replace(F.regexp_replace(F.lower(wanted), r"^www\.", ""), r"^\.", "")
    return (f != "") & ((h == f) | F.endswith(h, F.concat(F.lit("."), f)))


def display_host(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", ""), url)


def last_segment(url: Column) -> Column:
    """The last part of the path, decoded, or else the host name."""
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")
    last = F.try_element_at(parts, F.lit(-1))
    return F.coalesce(decode_percent(last), last, F.try_parse_url(url, F.lit("HOST")), url)


def query_param(url: Column, name: str) -> Column:
    """The decoded first value of a parameter; '' if it has none, null if it is absent."""
    raw = F.regexp_extract(F.regexp_replace(url, "#.*$", ""), rf"[?&]{name}=([^&]*)", 1)
    return F.when(F.regexp_like(url, F.lit(rf"[?&]{name}(=|&|$)")), F.coalesce(F.try_url_decode(raw), raw))


def unwrap_redirect(url: Column) -> Column:
    """The plain target in the first parameter that holds a web address, or the address itself."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    values = F.array(*[query_param(raw, name) for name in PASS_PARAMS])
    again = F.transform(values, lambda v: F.when(v.rlike(r"(?i)^(https?://|/)"), F.coalesce(decode_percent(v), v)))
    return F.coalesce(F.get(F.filter(again, lambda x: x.rlike(r"(?i)^https?://")), F.lit(0)), raw)


def decode_target(value: Column) -> Column:
    """A web address that is given plainly, or in base64 (either alphabet) after a marker of up to three characters."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    tries = [F.when(raw.rlike(r"(?i)^https?://"), raw)]
    for skip in range(4):
        code = F.regexp_replace(F.translate(F.substr(raw, F.lit(skip + 1)), "-_", "+/"), "[^A-Za-z0-9+/].*$", "")
        padded = F.rpad(code, F.greatest((F.ceil(F.length(code) / 4) * 4).cast("int"), F.lit(0)), "=")
        text = F.try_to_binary(padded, F.lit("base64"))
        said = F.when(F.is_valid_utf8(text.cast("string")), text.cast("string"))
        tries.append(F.when((F.length(raw) > skip) & said.rlike(r"(?i)^https?://[^\s\x00-\x1f]+$") & ~F.contains(said, F.lit("�")), said))
    return F.coalesce(*tries)


def wrapper_target(url: Column) -> Column:
    """The target inside a redirect wrapper, decoded without a request; null if there is none."""
    values = F.array(*[query_param(F.trim(url), name) for name in CARRY_PARAMS])
    return F.get(F.filter(F.transform(values, decode_target), lambda x: x.isNotNull()), F.lit(0))


def is_wrapper(url: Column, u: str = "u") -> Column:
    """Whether an address with parsed struct ``u`` hides its target behind a redirect."""
    host, path = F.col(f"{u}.host"), F.col(f"{u}.path")
    direct = path.rlike(r"(?i)^/(link|l/?|url|ck/a|interstitial|redirect)$")
    carried = url.rlike(r"(?i)[?&](uddg|url|u|q|target|m)=") & path.rlike(r"(?i)/link|/l/|/url|/ck/a")
    return F.coalesce(host.isin(*WRAPPER_HOSTS) & (direct | carried), F.lit(False))


def absolute_url(href: Column, base: Column) -> Column:
    """``href`` against ``base``; null for scripts, mail, phones, data and bare fragments. Dot segments are left to ``with_url``."""
    h = F.trim(F.coalesce(href, F.lit("")))
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    way = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)$", "$1/")
    return (
        F.when((h == "") | h.rlike(r"(?i)^(#|javascript:|mailto:|tel:|data:|blob:)"), F.lit(None).cast("string"))
        .when(h.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), h)
        .when(F.startswith(h, F.lit("//")), F.concat(scheme, h))
        .when(F.startswith(h, F.lit("/")), F.concat(origin, h))
        .when(F.startswith(h, F.lit("?")), F.concat(way, h))
        .otherwise(F.concat(F.regexp_replace(way, r"[^/]*$", ""), h))
    )


def is_private_host(host: Column) -> Column:
    """Loopback, link-local and private addresses and names."""
    h = dotted(F.regexp_replace(F.lower(host), r"^\[|\]$", ""))
    return h.rlike(r"^(localhost|::1|0\.0\.0\.0)$|\.(localhost|local|internal)$|^127\.|^10\.|^192\.168\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^f[cd][0-9a-f]{2}:|^fe80:")


def fetch_refusal(url: Column, allow_private: bool = False) -> Column:
    """Why an address must not be fetched, or null."""
    scheme = F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*:/*(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return (
        F.when(F.coalesce(scheme, F.lit("")) == "", F.lit("not a valid absolute URL"))
        .when(~scheme.isin("http", "https"), F.concat(F.lit('unsupported scheme "'), scheme, F.lit(':"')))
        .when(host == "", F.lit("not a valid absolute URL"))
        .when(F.lit(not allow_private) & is_private_host(host), F.lit("private/loopback address"))
    )
