"""Every query that SQL can follow, on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows):
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, con, name):
    mine = catalog.queries()[name](spark, SF)
    rel = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    assert sorted(mine.columns) == sorted(columns)
    assert plain(mine.select(columns).collect()) == plain(rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["passages_selected", "snippets"])
def test_every_query_meets_the_documents_with_its_terms(spark, name):
    from lodestar.plans import texts

    docs = [(r.doc_id, (r.text or "").lower()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    asked = [(r.query_id, r.query.split()) for r in texts.asked(spark, SF).collect()]
    pairs = sorted((i, k) for i, text in docs for k, terms in asked if any(t in text for t in terms))
    found = catalog.queries()[name](spark, SF).select("doc_id", "query_id").collect()
    assert len({k for _, k in pairs}) > 4 and sorted(map(tuple, found)) == pairs


def test_unwrap_redirects_of_long_and_escaped_addresses(spark, tmp_path):
    urls = ["https://blog.example.org/" + "x" * n for n in (32, 33, 60, 300)] + ["https://example.org/a%20b%2Fc?q=1%26+2", "https://example.org/100%", "https://example.org/\u00fc?x=%C3%BC"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = catalog.queries()["unwrap_redirects"](spark, str(tmp_path))
    assert plain(found.collect()) == plain(c.execute(catalog.oracle_sql()["unwrap_redirects"]).fetchall())


def test_title_similarity_pairs_of_copies(spark, tmp_path):
    """Copies meet other titles as one, and all pairs of pages come back."""
    said = ["one two three four five six"] * 40 + ["one two three four five seven"] * 3 + ["short", "Short.", "", "..", "five six"]
    rows = [(100 - i, f"https://h{i % 5}.example.{'com' if i % 7 else 'org'}/p{i}", f"<html><title>{t}</title></html>") for i, t in enumerate(said)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = catalog.queries()["title_similarity_pairs"](spark, str(tmp_path))
    assert plain(found.collect()) == plain(c.execute(catalog.oracle_sql()["title_similarity_pairs"]).fetchall())


def test_title_similarity_pairs_counts_no_shingles_of_pairs_of_copies(spark, tmp_path):
    n = 60
    spark.createDataFrame([(i, f"https://example.com/{i}", "<title>a b c d e f g h</title>") for i in range(n)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = catalog.queries()["title_similarity_pairs"](spark, str(tmp_path))
    assert found.count() == n * (n - 1) // 2
    widest = [r.n for r in found.groupBy("similarity").agg(F.count(F.lit(1)).alias("n")).collect()]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert widest == [n * (n - 1) // 2] and "Union" in plan  # equal titles don't pass through the count of shared shingles


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
