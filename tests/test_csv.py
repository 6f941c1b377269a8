"""CSV written and read again, with texts that are easily lost on the way."""

import pytest

from promptgrid.plans import queries
from promptgrid.sources import readers, writers

TEXTS = ["", None, " ", "a", "\0", "\n\0\0a\0", '"\0"', '\0"\n', '""', ',"\0', "\r", "\r\n", "null", "\\", '\\"', "a\n"]


@pytest.mark.parametrize("multi_line", [True, False])
def test_texts_come_back(spark, tmp_path, multi_line):
    texts = TEXTS if multi_line else [t for t in TEXTS if not {*(t or "")} & {*"\r\n"}]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    writers.to_csv(rows, path := str(tmp_path / "a.csv"))
    assert {r["id"]: r["text"] for r in readers.read_csv(spark, path, multi_line=multi_line).collect()} == dict(enumerate(texts))
    assert {r["id"]: r["text"] for r in readers.read_csv(spark, path, "id int, text string", multi_line).collect()} == dict(enumerate(texts))


def test_only_column(spark, tmp_path):
    """Each row of a single column is there again, as an empty text where it was null."""
    writers.to_csv(spark.createDataFrame([(t,) for t in TEXTS], "text string"), path := str(tmp_path / "a.csv"))
    assert sorted(r["text"] for r in readers.read_csv(spark, path).collect()) == sorted(t or "" for t in TEXTS)


def test_quoted_blank_numbers(spark, tmp_path):
    """They are null, and the column stays one of numbers."""
    (tmp_path / "a.csv").write_text('id,n,text\n1,"",x\n2,,\n3,4,""\n')
    rows = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert rows.dtypes[1] == ("n", "int") and sorted(map(tuple, rows.collect())) == [(1, None, "x"), (2, None, None), (3, 4, "")]


@pytest.mark.parametrize("name", ["src_csv", "sink_csv"])
def test_queries(spark, tmp_path, name):
    """The queries against their SQL, over documents with such texts and blank languages."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, t, lang, None if i == 7 else "src1", 1) for i, (t, lang) in enumerate((t, lang) for t in TEXTS for lang in ("en", "fr", "", None))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = queries.queries()[name](spark, str(tmp_path))
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, cursor.fetchall()))
