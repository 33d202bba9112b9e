"""Queries that have no SQL, against plain versions."""

from __future__ import annotations

import os
import re
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from loomline.operators import linkage
from loomline.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def table(sql):
    return duckdb.sql(sql.replace("FROM ", f"FROM '{DATA}/").replace(" T", ".parquet'")).fetchall()


def test_long_text_dedup(spark):
    turns = {}
    for conv, _, text in table("SELECT conv_id, turn, text FROM conversations T ORDER BY conv_id, turn, text"):
        turns.setdefault(conv, []).append(text)

    def same(a, b):
        a, b = a.lower(), b.lower()
        n = len(os.path.commonprefix([a, b]))
        return a == b or (n >= 200 and len(a) - n <= 160 and len(b) - n <= 160)

    want = {}
    for conv, texts in turns.items():
        kept = []
        for t in texts:
            if t and t.strip() and not any(same(k, t) for k in kept):
                kept.append(t)
        want[conv] = "\n\n".join(kept)
    assert {r["conv_id"]: r["kept"] for r in catalogue.queries()["long_text_dedup"](spark, DATA).collect()} == want


def test_seo_keywords(spark):
    stop = {"the", "and", "of", "for"}

    def stem(w):
        out = w
        for suffix in ("ed", "er", "ers", "ing"):
            if w.endswith(suffix) and len(w) > len(suffix) + 3 and " " not in w:
                cut = w[: -len(suffix)]
                out = cut[:-1] if cut[-1] == cut[-2] else cut
        return out

    words = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w and w not in stop]
    want = {}
    for key, name, brand, kind in table("SELECT p_partkey, p_name, p_brand, p_type FROM part T"):
        title = words(name)
        found = [*dict.fromkeys(words(f"{name} {brand} {kind}")), *(f"{a} {b}" for a, b in zip(title, title[1:], strict=False))]
        kept = []
        for w in found:
            if len(w) >= 3 and not any(stem(k) == stem(w) or k == w for k in kept):
                kept.append(w)
        want[key] = kept[:20]
    assert {r["p_partkey"]: r["keywords"] for r in catalogue.queries()["seo_keywords"](spark, DATA).collect()} == want


def test_match_full(spark):
    def tokens(t):
        return list(dict.fromkeys(w for w in re.split("[^a-z0-9]+", t.lower()) if len(w) > 1))

    def similarity(a, b):
        x, y = tokens(a), tokens(b)
        if not x or not y:
            return 0.0
        both, small, large = len({*x} & {*y}), min(len(x), len(y)), max(len(x), len(y))
        sets = 0.8 * both / small + 0.2 * both / large if both / small >= 0.85 and both / large >= 0.6 and both >= 3 else both / len({*x, *y})
        return max(sets, SequenceMatcher(None, " ".join(sorted(x)), " ".join(sorted(y))).ratio() * small / large)

    names = {}
    for brand, name in table("SELECT DISTINCT p_brand, p_name FROM part T"):
        names.setdefault(brand, []).append(name)
    pairs = [(b, x, y, similarity(x, y)) for b, ns in names.items() for x in ns for y in ns if x != y and {*tokens(x)} & {*tokens(y)}]
    df = spark.createDataFrame(pairs, "brand string, a string, b string, sim double")
    assert df.where(F.abs(linkage.title_similarity(F.col("a"), F.col("b")) - F.col("sim")) > 1e-9).count() == 0
    got = catalogue.queries()["match_full"](spark, DATA).collect()
    assert {(r["brand"], r["source"]) for r in got} == {(b, x) for b, x, *_ in pairs}
    known = {(b, x, y) for b, x, y, _ in pairs}
    assert all((r["brand"], r["source"], r["candidate"]) in known for r in got)
