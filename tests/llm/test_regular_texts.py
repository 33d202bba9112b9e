"""Words whose letters alternate by the parity of their places' bits, on which sums of powers modulo a power of two agree."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from loomline.llm import common, decontaminate, jaccard_join, quality_rules, rans, substring_dedup

ONE = "".join("ab"[k.bit_count() & 1] for k in range(1024))
OTHER = "".join("ba"[k.bit_count() & 1] for k in range(1024))


def test_hashes_differ():
    data = np.frombuffer((ONE + OTHER).encode(), np.uint8)
    for seed in range(40):
        for size in (128, 256, 512, 1024):
            a, b = common.Rolling(data, seed).of(np.array([0, 1024]), np.array([size, 1024 + size]))
            assert a != b


def test_ranges_of_equal_bytes():
    data = np.random.default_rng(8).integers(0, 256, 200_000).astype(np.uint8)
    data[150_000:190_000] = data[3:40_003]
    rolling = common.Rolling(data, 4)
    start = np.arange(0, 39_000, 7)
    assert (rolling.of(start + 3, start + 500) == rolling.of(start + 150_000, start + 150_497)).all()
    assert (rolling.windows(77)[start] == rolling.of(start, start + 77)).all()
    assert len(np.unique(rolling.windows(9)[:150_000])) == 150_000


def test_tokens():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        content = f.read()
    ids, _ = rans.Tokens(content)(pa.array([f"{ONE} {OTHER} {ONE}"]), 1)
    assert ids.tolist() == [*Tokenizer.from_buffer(content).encode(f"{ONE} {OTHER} {ONE}", add_special_tokens=False).ids, 1]


def test_sets_lines_and_seeds(spark):
    h, _ = jaccard_join.sets_of(pa.array([ONE, OTHER]))
    assert len(set(h.tolist())) == 2
    row = quality_rules.judged(spark.createDataFrame([(1, f"{ONE}\n{OTHER}\n{ONE}", "h")], "doc_id long, text string, source string")).first()
    assert row["n_dup_lines"] == 1
    words, _ = decontaminate.worded([f"{ONE} {OTHER}"])
    assert words[0] != words[1]
    kept = {r["doc_id"]: r["spans"] for r in substring_dedup.deduplicated(spark.createDataFrame([(1, "x" + ONE[:500] + "y"), (2, "z" + OTHER[:500] + "w")], "doc_id long, text string")).collect()}
    want = {d: [t[p : p + 400] for p in range(len(t) - 399)] for d, t in ((1, "x" + ONE[:500] + "y"), (2, "z" + OTHER[:500] + "w"))}
    shared = {s for s in want[1] + want[2] if (want[1] + want[2]).count(s) > 1}
    assert all(bool(kept[d]) == any(s in shared for s in want[d]) for d in (1, 2))


def test_short_ranges():
    chance = np.random.default_rng(3)
    words = [chance.integers(97, 100, n).astype(np.uint8).tobytes() for n in chance.integers(0, 40, 3000)] + [b"a" * n for n in range(600)] + [ONE.encode(), OTHER.encode(), b"\0", b"\0\0", b"a\0"]
    words += words[:50]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - np.array([len(w) for w in words])
    one, two = (common.words_hashed(data, starts, ends, seed) for seed in (1, 2))
    known = {}
    for word, h in zip(words, one.tolist(), strict=True):
        assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known) and not (one == two).any()
    assert len(common.words_hashed(data[:0], starts[:0], ends[:0], 1)) == 0
