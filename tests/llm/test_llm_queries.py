"""The pN_ queries over the smallest tables; those with a SQL twin against it."""

import glob
import os

import duckdb
import pytest

from quaero.llm import queries as q

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, con, name):
    df = q.queries()[name](spark, D)
    rows = [tuple(r) for r in df.collect()]
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
    if name in q.oracle_sql():
        c = con.execute(q.oracle_sql()[name])
        names = [x[0] for x in c.description]
        at = [names.index(x) for x in df.columns]
        assert sorted(map(str, rows)) == sorted(str(tuple(r[i] for i in at)) for r in c.fetchall())


@pytest.mark.parametrize(
    "name, columns",
    [("p1_found", ["src", "qid", "lang"]), ("p2_found", ["pubkey_a", "pubkey_b"]), ("p3_found", ["qid", "defect"]), ("p4_found", ["run_name", "qid", "docid"]), ("p5_found", ["train_qid", "eval_qid"]), ("p6_found", ["src", "rec_key"]), ("p7_ids", ["doc_id", "ids"]), ("p9_found", ["doc_id"])],
)
def test_columns(spark, name, columns):
    assert q.queries()[name](spark, D).columns == columns


def test_forms_of_both_tables(spark):
    """p6_forms gives every post and every abstract; its changed rows are p6_found."""
    f = q.queries()["p6_forms"](spark, D)
    assert f.columns == ["src", "rec_key", "form", "changed"]
    rows = f.collect()
    assert len(set(rows)) == len(rows)
    for src, key in (("en_train", "qid"), ("collection_data", "pubkey")):
        want = {r[0] for r in spark.read.parquet(f"{D}/{src}.parquet").select(key).collect()}
        assert {r.rec_key for r in rows if r.src == src} == want
    found = {tuple(r) for r in q.queries()["p6_found"](spark, D).collect()}
    assert found and {(r.src, r.rec_key) for r in rows if r.changed} == found
