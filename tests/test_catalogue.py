"""Every query against its SQL, run by DuckDB on the same tables."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from engram.plans import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in SQL:
        assert rows
        return
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)


def test_absolute_texts_as_sql(spark, duck, tmp_path):
    """Every first letter, and vague words beside letters that engines fold and bound differently."""
    near = ["", " ", "a", "é", "ß", "ſ", "_", "7", "\u0301", "\n\n", "\x0b", "\x0c", "\u00a0", "\u212a", "\u200d", "\u0130", "."]
    vague = ["maybe", "PERHAPS", "po\u017f\u017fibly", "\u017feems like", "I thin\u212a", "\u212aind of", "it seems", "roughly", "about", "more or less", "could"]
    texts = [a + w + b + "x" for a in near for w in vague for b in near] + [a + "x" + b for a in near for b in near]
    texts += [chr(i) + "ear" for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000] + ["", None, "  maybe ", "ß", "ßa\n\n\nb"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = dict(c.execute(SQL["make_absolute"]).fetchall())
    got = {r.doc_id: r.digest for r in QUERIES["make_absolute"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and [(texts[i], hex(ord(texts[i][0]))) for i in got if got[i] != expected[i]] == []
