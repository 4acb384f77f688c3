import pytest

from quire.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(columns).collect())
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


#: Pages whose texts end within a character reference, or have one without its semicolon.
CUT = ["<p>ver&amp</p><p>&&amp;&amp</p>", "<div>one<p>two &am</p>x &quot</div><p>&copy; &copy</p>", "<p>&amp;amp</p><p> &amp;lt; &ampx; </p><p>e&amp</p><p>&amp;</p><p>5 &lt 6 &gt; 7</p><p>&amp</p>"]


@pytest.mark.parametrize("name", ["html_reinject", "html_text_nodes"])
def test_query_equals_sql_on_cut_references(name, spark, duck, tmp_path):
    spark.createDataFrame(list(enumerate(CUT)), "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select("page_id", "n", "text").collect())
    cut = duck.cursor()  # a temporary view stands before the shared one in this cursor alone
    cut.execute(f"CREATE TEMP VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(cut.execute(f"SELECT page_id, n, text FROM ({ORACLES[name]})").fetchall())
    assert len(want) == 12 and got == want


def test_entry_point(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
