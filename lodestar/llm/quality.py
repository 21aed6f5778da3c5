"""Quality rules with adaptive thresholds (operator 1).

Every document gets four integer signals in thousandths. For each (language, source) the
signals are summarised in a *mergeable quantile sketch*: a histogram of 1001 equal bins, kept
as one row per non-empty bin, so merging is addition and Spark pre-aggregates it before the
shuffle. A group's threshold is its upper quartile plus the larger of ``FENCE`` interquartile
ranges and a floor; a group of fewer than ``MIN_GROUP`` documents takes its language's merged
sketch, or else that of all documents. A group of which much is junk would set itself a threshold that passes
junk, so one above the least of those merged sketches is lowered to that, or to the group's lower quartile plus
the floor where this is higher. The thresholds are joined back and documents beyond any of them go.

Defined cases: null or empty text has no words and fails the base rules; null language or source
counts as an empty string; a value that ties with its threshold passes; repeated rows are judged each on their own; texts may be of any length; other
columns, whatever their names, are ignored or, by ``quality_filter``, kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, as_bytes, map_arrow, packed, tune, unpacked, written

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
#: Signals in thousandths with the least distance of a threshold above the upper quartile.
FLOORS = {"m_symbols": 60, "m_dup_lines": 400, "m_repeat_words": 300, "m_upper": 300}
FENCE = 6
MIN_GROUP = 30
#: Up to so many groups the thresholds (under 100 bytes a row) are broadcast; beyond it a salted join is used.
BROADCAST_GROUPS = 50_000
SALTS = 64

NEEDED = ["doc_id", "text", "lang", "source"]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_lines", "n_upper"]


def repeat_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that occur at least twice."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if count[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def measure(text: bytes | None, code_points: int) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    spaces = len(text) - len(text.translate(None, ASCII_SPACE))
    return (
        len(words),
        code_points - spaces,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        len(text) - len(text.translate(None, UPPER)),
    )


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``_q`` of the counts; every other column passes through."""
    fields = [pa.field(c, pa.int64()) for c in COUNTS]
    schema = T.StructType([*docs.schema.fields, T.StructField("_q", T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])
    at = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            column = batch.column(at)
            lengths = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
            rows = [measure(t, n) for t, n in zip(as_bytes(column), lengths, strict=True)]
            values = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(values, fields=fields)], names=[*batch.schema.names, "_q"])

    return map_arrow(docs, run, schema)


def signals(q: str = "_q") -> dict[str, Column]:
    c = lambda name: F.col(f"{q}.{name}")
    share = lambda n, d: F.when(c(d) > 0, F.expr(f"({q}.{n} * 1000L) div {q}.{d}")).otherwise(F.lit(0)).cast("int")
    return {"m_symbols": share("n_symbols", "word_chars"), "m_dup_lines": share("n_dup_lines", "n_lines"), "m_repeat_words": share("n_repeat_words", "n_words"), "m_upper": share("n_upper", "word_chars")}


def base_failed(q: str = "_q") -> Column:
    return (F.col(f"{q}.n_words") < 50) | (F.col(f"{q}.n_repeat_words") * 100 > F.col(f"{q}.n_words") * 50)


def sketch(measured: DataFrame) -> DataFrame:
    """One row per (lang, source, signal, bin) with its count: the mergeable sketches of all documents that have words."""
    bins = F.explode(F.map_from_arrays(F.array(*[F.lit(s) for s in FLOORS]), F.array(*signals().values()))).alias("signal", "bin")
    return (
        measured.filter("_q.n_words > 0")
        .select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), bins)
        .groupBy("lang", "source", "signal", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold of each signal for each value of ``keys``, from merged sketches; other groups don't lower it below ``least``, and ``n`` counts its documents.

    The bins of one group are gathered in an array of at most 1001 entries and scanned there."""
    merged = sketches.groupBy(*keys, "signal", "bin").agg(F.sum("n").alias("n"))
    grouped = merged.groupBy(*keys, "signal").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("n"))
    quantile = lambda k: F.expr(
        f"aggregate(bins, named_struct('c', 0L, 'v', -1), (a, x) -> named_struct('c', a.c + x.n, 'v', if(a.v < 0 and (a.c + x.n) * 4 >= {k} * n, x.bin, a.v)), a -> a.v)"
    )
    floor = F.create_map(*[F.lit(x) for kv in FLOORS.items() for x in kv])
    high, low = quantile(3), quantile(1)
    return grouped.select(*keys, "signal", "n", (high + F.greatest((high - low) * FENCE, floor[F.col("signal")])).alias("t"), (low + floor[F.col("signal")]).alias("least")).groupBy(*keys).pivot("signal", list(FLOORS)).agg(F.first("t").alias("t"), F.first("least").alias("least"), F.first("n").alias("n"))


def thresholds(measured: DataFrame) -> DataFrame:
    """One row per (lang, source) with its four thresholds."""
    sketches = written(sketch(measured), "quality-sketch")
    first = next(iter(FLOORS))
    cut = lambda keys, p: _fences(sketches, keys).select(*keys, *[F.col(f"{s}_{x}").alias(f"{p}{x}_{s}") for s in FLOORS for x in ("t", "least")], F.col(f"{first}_n").alias(f"{p}n"))
    own, lang = cut(["lang", "source"], "o_"), cut(["lang"], "l_")
    every = _fences(sketches.withColumn("one", F.lit(1)), ["one"]).first()  # a single row

    def chosen(s: str) -> Column:
        top = F.lit(every[f"{s}_t"] if every else 1000)
        bounded = lambda p, by: F.least(F.col(f"{p}t_{s}"), F.greatest(F.col(f"{p}least_{s}"), by))
        of_lang = F.when(F.col("l_n") >= MIN_GROUP, bounded("l_", top)).otherwise(top)
        return F.when(F.col("o_n") >= MIN_GROUP, bounded("o_", F.least(of_lang, top))).otherwise(of_lang)

    return own.join(lang, "lang").select("lang", "source", *[chosen(s).cast("int").alias(f"t_{s}") for s in FLOORS])


def judged(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """``measured`` with ``_kept``: base rules and thresholds both passed."""
    small = cuts.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[f"t_{s}" for s in FLOORS])
    keyed = measured.withColumn("_lang", F.coalesce("lang", F.lit(""))).withColumn("_source", F.coalesce("source", F.lit("")))
    if small.count() <= BROADCAST_GROUPS:
        joined = keyed.join(F.broadcast(small), ["_lang", "_source"], "left")
    else:
        salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "_q"), F.lit(SALTS)).cast("int")).join(salted, ["_lang", "_source", "_salt"], "left").drop("_salt")
    within = F.lit(True)
    for s, value in signals().items():
        within &= value <= F.coalesce(F.col(f"t_{s}"), F.lit(1000))
    return joined.withColumn("_kept", ~base_failed() & within).drop("_lang", "_source")


def quality(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, signals, thresholds and verdict."""
    tune(docs.sparkSession)
    measured = written(with_counts(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality-counts")
    out = judged(measured, written(thresholds(measured), "quality-cuts"))
    return out.select("doc_id", *[F.col(f"_q.{c}").alias(c) for c in BASE], base_failed().alias("base_failed"), F.col("_kept").alias("kept"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with. Repeated rows need no key: each row is measured again and judged."""
    tune(docs.sparkSession)
    measured = with_counts(docs.select("doc_id", "text", "lang", "source")).drop("text")
    cuts = written(thresholds(measured), "quality-cuts")
    kept = judged(with_counts(packed(docs, NEEDED)), cuts).filter("_kept")
    return unpacked(kept, docs.columns, NEEDED)


_BINS = " union all ".join(f"select lang, source, '{s}' as signal, {s} as bin from s" for s in FLOORS)
_FLOOR = "case signal " + " ".join(f"when '{s}' then {v}" for s, v in FLOORS.items()) + " end"


def _sql_fence(keys: str) -> str:
    by = f"{keys}, " if keys else ""
    over = f"partition by {by}signal order by bin"
    return f"""select {by}signal, n, q3 + greatest({FENCE} * (q3 - q1), {_FLOOR}) as t from (
      select {by}signal, max(total) as n, min(bin) filter (where c * 4 >= 3 * total) as q3, min(bin) filter (where c * 4 >= total) as q1 from (
        select {by}signal, bin, sum(n) over ({over}) as c, sum(n) over (partition by {by}signal) as total
        from (select {by}signal, bin, count(*) as n from b group by {by}signal, bin)) group by {by}signal)"""


WORD = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = rf"""
with w as (select row_number() over () as r, doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as words from documents),
p as (select r, unnest(range(1, len(words) - 1)) as i, words from w where len(words) >= 3),
g as (select r, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] as g from p),
h as (select r, i from (select r, i, count(*) over (partition by r, g) as n from g) where n > 1),
rw as (select r, count(distinct i + k) as n from h, (select unnest([0, 1, 2]) as k) group by r),
q as (select w.doc_id, lang, source, len(words)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g'))::bigint as n_upper,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines, coalesce(rw.n, 0)::bigint as n_repeat_words
  from w left join rw on w.r = rw.r),
d as (select *, len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from q),
s as (select *, case when word_chars > 0 then n_symbols * 1000 // word_chars else 0 end as m_symbols, case when n_lines > 0 then n_dup_lines * 1000 // n_lines else 0 end as m_dup_lines,
  case when n_words > 0 then n_repeat_words * 1000 // n_words else 0 end as m_repeat_words, case when word_chars > 0 then n_upper * 1000 // word_chars else 0 end as m_upper from d),
b as (select * from ({_BINS.replace("from s", "from s where n_words > 0")})),
fo as ({_sql_fence("lang, source")}), fl as ({_sql_fence("lang")}), fa as ({_sql_fence("")}),
t as (select fo.lang, fo.source, fo.signal, case when fo.n >= {MIN_GROUP} then fo.t when fl.n >= {MIN_GROUP} then fl.t else fa.t end as t
  from fo join fl on fo.lang = fl.lang and fo.signal = fl.signal join fa on fa.signal = fo.signal),
v as (pivot t on signal in ({", ".join(f"'{x}'" for x in FLOORS)}) using first(t) group by lang, source)
select s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and {" and ".join(f"s.{x} <= coalesce(v.{x}, 1000)" for x in FLOORS)} as kept
from s left join v on s.lang = v.lang and s.source = v.source
"""
