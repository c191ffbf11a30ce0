"""Queries of the subpackage against their SQL on the smallest tables."""

import os

import pytest

from docloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, df.select(columns).collect()), key=key) == sorted(map(tuple, cursor.fetchall()), key=key)


def test_html_query_on_whole_pages(spark):
    """Each page's article, taken out of the markup by plain regular expressions."""
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op6_html_text(spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))
        lines = (" ".join(html.unescape(re.sub(r"</?b>", "", p)).split()) for p in parts)
        assert r.text == "\n".join(x for x in lines if x)
