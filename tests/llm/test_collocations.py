"""Phrases against plain counting."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from loomline.llm import collocations

from .brute import LOWER

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(docs, least, top):
    total, f = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inner = collections.Counter()
    for (lang, *words), a in found.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = (lang, *words[i : i + k])
                inner[part] = max(inner[part], a)
    out = collections.defaultdict(list)
    for (lang, *words), a in found.items():
        if inner[(lang, *words)] < a:
            cuts = [(1000 * a * total[lang] // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k, f[(lang, *words[:k])], f[(lang, *words[k:])]) for k in range(1, len(words))]
            score, _, left, right = min(cuts)
            out[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, k, p.decode(), -a, x, y, total[lang], -s) for lang, rows in out.items() for k, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1))


def rows(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def docs():
    chance = random.Random(11)
    pool = ["der", "Die", "das", "of", "the", "OF", "a", "New", "York", "été", "x#1"]
    out = []
    for k in range(300):
        lang = chance.choice(["de", "en", None, "und", ""])
        words = "".join(chance.choice(pool) + chance.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ".", " "]) for _ in range(chance.randrange(80)))
        out.append((lang, chance.choice([None, "", " .,", words, words, words + " in the city of new york today"])))
    return [*out, *out[:40], ("en", "one long sentence repeats " * 3000), ("en", "-")]


@pytest.mark.parametrize(("least", "top", "leaf"), [(5, 2000, collocations.LEAF_ROWS), (12, 7, 3), (2, 40, 20)])
def test_counts(spark, docs, least, top, leaf):
    df = spark.createDataFrame([(lang, t, k, "x") for k, (lang, t) in enumerate(docs)], "lang string, text string, key int, word string")
    assert rows(collocations.collocations(df, least, top, leaf=leaf)) == plain(docs, least, top)


def test_nothing(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert rows(collocations.collocations(df)) == []
    df = spark.createDataFrame([(None, None), ("en", ""), ("en", "one")], "lang string, text string")
    assert rows(collocations.collocations(df, 1)) == []


def test_quicksort():
    chance = np.random.default_rng(2)
    suffixes = chance.integers(1, 5, (500, 5)).astype(np.uint64)
    suffixes[np.arange(500)[:, None] * 0 + np.arange(5) >= chance.integers(1, 6, 500)[:, None]] = 0
    weights = chance.integers(1, 4, 500)
    want = collections.Counter()
    for s, w in zip(suffixes.tolist(), weights.tolist(), strict=True):
        for d in range(1, 6):
            if s[d - 1]:
                want[tuple(s[:d])] += w
    got = {tuple(suffixes[p, :d].tolist()): w for p, d, w in collocations.frequent_parts(suffixes, weights, 10)}
    assert got == {p: w for p, w in want.items() if w >= 10}
