import __spark_entry__ as entry
import pytest


def test_names_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 39


@pytest.mark.parametrize("name", ["corpus_stats", "cut_strictest", "map_sequences", "vocab_diff"])
def test_queries_equal_their_sql(spark, name):
    import glob
    import os

    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    found = entry.queries()[name](spark, folder)
    names = sorted(found.columns)
    ours = sorted(map(repr, (tuple(r[c] for c in names) for r in found.collect())))
    theirs = db.execute(f"SELECT {', '.join(names)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert ours == sorted(map(repr, theirs))
