"""The registered queries over the smallest tables."""

from __future__ import annotations

import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from loomline.llm import bpe, common, queries

from . import brute

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text from read_parquet('{SMALL}/documents.parquet') order by 1").fetchall()


def rows(spark, name, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in queries.queries()[name](spark, SMALL).collect()}


def test_sql_is_text():
    assert all(isinstance(sql, str) and name in queries.queries() for name, sql in queries.oracle_sql().items())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages"):
        db.sql(f"create view {table} as select * from read_parquet('{SMALL}/{table}.parquet')")
    df, relation = queries.queries()[name](spark, SMALL), db.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[relation.columns.index(c)] for c in columns]) for r in relation.fetchall())


def test_op1(spark, docs):
    assert rows(spark, "op1_substring_dedup", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.substrings(docs)


def test_op2(spark, docs):
    gone = brute.lines_removed(docs)
    want = {}
    for d, text in docs:
        exact, near = gone.get(d, ((), ()))
        want[d] = (text.count("\n") + 1, len(exact), len(near), ",".join(map(str, sorted([*exact, *near]))))
    assert rows(spark, "op2_line_dedup", "n_lines", "n_exact", "n_near", "removed_lines") == want


def test_op4(spark, docs):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe.ranked(f.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {d: (len(ids := library.encode_ordinary(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in docs}
    assert rows(spark, "op4_bpe", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op8_base(spark, docs):
    want = {d: (hashlib.sha256(brute.personal(t).encode()).hexdigest(), *(brute.personal(t).count(f"{kind}:") for kind in ("email", "ip", "card", "phone"))) for d, t in docs}
    assert rows(spark, "op8_pii", "base_sha256", "n_email", "n_ip", "n_card", "n_phone") == want


def test_op9(spark, docs):
    library, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, {}
    for d, t in docs:
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert rows(spark, "op9_rans", "start", "n_tokens", "ids_crc32") == want


def test_cleanup(spark):
    table = common.saved(spark.range(3), "test")
    assert table.count() == 3
    common.cleanup(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.schema(table.schema).parquet(table.inputFiles()[0]).count()
