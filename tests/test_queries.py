"""Queries over small tables, against their SQL."""

import duckdb
import pytest

import __spark_entry__


@pytest.fixture
def both(spark, tmp_path):
    """Rows of a query and of its SQL over the given tables."""

    def run(query, **tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        found = __spark_entry__.queries()[query](spark, str(tmp_path))
        with duckdb.connect() as db:
            for name in tables:
                db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
            wanted = db.execute(f"SELECT {', '.join(found.columns)} FROM ({__spark_entry__.oracle_sql()[query]})").fetchall()
        return sorted(map(tuple, found.collect()), key=repr), sorted(wanted, key=repr)

    return run


def test_page_titles_with_references_cut_short_and_others(both):
    page = "<html><head><title>t</title><script>var t=1;</script></head><body><h1>{}</h1><p>text</p></body></html>"
    titles = ["a &amp; b", "ver&amp;&amp", "token = &quot;77", "x &lt;b&gt; &lt", "&amp;quot; &#39; &", "plain"]
    found, wanted = both("page_titles", pages=([(i, "https://example.com/a", page.format(t)) for i, t in enumerate(titles)], "page_id bigint, url string, html string"))
    assert found == wanted and [r[1] for r in found][:3] == ["a & b", "ver&&amp", "token = &quot;77"]


def test_pii_hits_whose_value_comes_again_in_the_line(both):
    lines = "first a.1@mail.example.com then a.1@mail.example.com\nxa.1@mail.example.com or a.1@mail.example.com\n090-1234-5678 and 090-1234-5678"
    found, wanted = both("pii_hits", documents=([(1, lines), (2, None)], "doc_id bigint, text string"))
    assert found == wanted and len(found) == 6


def test_overlap_scores_of_lines_that_differ_late(both):
    same = "a plain beginning " * 40
    documents = [(1, f"{same}left end\n{same}other tail, 市場"), (2, "x" * 499 + " yz\n" + "x" * 700), (3, None)]
    found, wanted = both("overlap_scores", documents=(documents, "doc_id bigint, text string"))
    assert found == wanted and len(found) == 2 and all(0 < r[2] < 1 for r in found)
