"""Each query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from loomline.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)[:19] if hasattr(value, "isoformat") else str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    relation = db.sql(catalogue.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    assert sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(_plain(r[p]) for p in places) for r in relation.fetchall())


def test_hosts_rules_fit_paths_without_queries(spark, tmp_path):
    urls = ["http://a.com/en/817?utm_source=feed", "http://a.com/en/8?id=7", "http://a.com/en/9#7", "http://a.com/en/7", "http://a.com/zz/1", "http://b.com", "http://b.com/x/1", "http://c.com/q/1?x=/q/7"]
    spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.sql(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = dict(db.sql(catalogue.oracle_sql()["urls_allowed_by_host"]).fetchall())
    got = [tuple(r) for r in catalogue.queries()["urls_allowed_by_host"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want.items()) and want["http://a.com/en/817?utm_source=feed"] and not want["http://a.com/en/8?id=7"]


CUT = "Fish &amp; chips &amp;&"


@pytest.mark.parametrize("name", ["main_text", "main_text_unnamed", "page_markdown", "selector_values"])
def test_references_cut_short(spark, tmp_path, name):
    pages = [(k, f"https://s.com/{k}", f'<html lang="en"><head><meta charset="utf-8"><title>{CUT}{cut}</title></head><body><div class="ad">x &middot{cut}</div><article><h1>{CUT}{cut}</h1><p>Of {CUT}{cut}</p></article></body></html>') for k, cut in enumerate(["amp", "am", "a", "quo", "copy", "amp;", "#39", "lt"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.sql(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    df = catalogue.queries()[name](spark, str(tmp_path))
    columns = ", ".join(sorted(df.columns))
    want = db.sql(f"SELECT {columns} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(_plain(v) for v in r) for r in df.selectExpr(*columns.split(", ")).collect()) == sorted(tuple(_plain(v) for v in r) for r in want) and len(want) >= len(pages)
