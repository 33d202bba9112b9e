"""Alignment of two tokenizers against the libraries and plain merging of their ends."""

from __future__ import annotations

import collections
import hashlib
import os
import random

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomline.llm import alignment, queries

SMALL = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain(docs):
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    signs = alignment.byte_signs()
    out, links, docs_of = [], [], collections.Counter()
    for _, text in docs:
        groups, pairs = [], []
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            sides = [[bytes(signs[c] for c in first.id_to_token(i)) for i in a], [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(second.id_to_piece, b), strict=True)]]
            if all(b"".join(s) == (" " + text).encode() for s in sides):
                owner = [[k for k, token in enumerate(s) for _ in token] for s in sides]
                pairs = [(a[i], b[j]) for i, j in sorted(set(zip(*owner, strict=True)))]
                ends = [{sum(map(len, s[: k + 1])): k + 1 for k in range(len(s))} if len(s) < 300 else _ends(s) for s in sides]
                last = (0, 0)
                for e in sorted(ends[0].keys() & ends[1].keys()):
                    now = (ends[0][e], ends[1][e])
                    groups.append((a[last[0] : now[0]], b[last[1] : now[1]]))
                    last = now
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(pairs), ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)))
        links.append(pairs)
        docs_of.update(set(pairs))
    most = {}
    for (a, _), n in docs_of.items():
        most[a] = max(n, most.get(a, 0))
    return sorted(((d, *o[:4], sum(docs_of[p] == most[p[0]] for p in pairs), sum(docs_of[p] for p in pairs), hashlib.sha256(o[4].encode()).hexdigest() if o[4] else "") for (d, _), o, pairs in zip(docs, out, links, strict=True)), key=str)


def _ends(tokens):
    total, out = 0, {}
    for k, token in enumerate(tokens):
        total += len(token)
        out[total] = k + 1
    return out


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def run(df):
    held = alignment.common.saved(alignment.blocks(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")), "aligned")
    return rows(alignment.scored(held, alignment.pair_counts(held)))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_query(spark):
    docs = duckdb.sql(f"select doc_id, text from read_parquet('{SMALL}/documents.parquet')").fetchall()
    assert rows(queries.queries()["op12_alignment"](spark, SMALL)) == plain(docs)


def test_cases(spark, monkeypatch):
    chance = random.Random(4)
    odd = [None, "", " ", "a", " a", "a  b ", "tab\tand\nline \n end", "a▁b", "plain then ▁", "<|endoftext|> <s> </s> <0x41> <unk>", "ﬁ é é ​　x", "don't we'll 12345 !?!", "\x00\x1c a", "日本語 テキスト 🎉🎉", "x" * 5000]
    texts = [*odd, *odd[3:6], "".join(chance.choice([" ", "\n", "the ", "Wort", "ñandú", "'s", "9", "🎉", ","]) for _ in range(30_000))]
    texts += ["".join(chance.choice("ab \n,é'9") for _ in range(chance.randrange(1, 60))) for _ in range(200)]
    docs = [(k % 190, t) for k, t in enumerate(texts)] + [(None, "no id")]
    want = plain(docs)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, block string, seq int")
    assert run(df) == want
    monkeypatch.setattr(alignment, "_ROW_LINKS", 50)
    assert run(df.repartition(1)) == want
    assert run(df.limit(0)) == []
    assert run(df.where("text = ''")) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_diagonals():
    """Stretches, groups and links of random ends against sets."""
    chance = random.Random(9)
    for _ in range(300):
        total = chance.randrange(1, 120)
        a, b = (sorted({*chance.sample(range(1, total + 1), chance.randrange(total)), total}) for _ in range(2))
        if chance.random() < 0.5:
            b = sorted({*a} ^ {*chance.sample(range(1, total + 1), min(3, total))} | {total})
        starts_a, starts_b, lengths, links_a, links_b = alignment.aligned(a, b)
        links = list(zip(links_a, links_b, strict=True)) + [(i + k, j + k) for i, j, n in zip(starts_a, starts_b, lengths, strict=True) for k in range(n)]
        assert sorted(links) == sorted({(sum(e <= x for e in a), sum(e <= x for e in b)) for x in range(total)})
        closed = [a[i + k] for i, n in zip(starts_a, lengths, strict=True) for k in range(n)] + [a[i - 1] for i, n in zip(starts_a, lengths, strict=True) if not n]
        assert sorted(closed) == sorted(set(a) & set(b))


def test_encoding_at_once_and_remembered():
    """Texts encoded together have the ids that each has alone, and chunks without ids are found by the set of these."""
    files = []
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        with open(public_tokenizers.path(name), "rb") as f:
            files.append(f.read())
    v = alignment.Vocabularies(*files)
    texts = ["plain words", "", "ﬁ ligature", "ﬁ", "é é 　x", "a\nb \n c", "tab\tx", "😀", "\x00"]
    together = v.encode(texts)
    assert together == [v.encode([t])[0] for t in texts] and v.encode([]) == []
    for _ in range(2):
        assert v.ids(texts) == [(b"", b"") if not t else v.encode([t])[0] for t in texts]
    assert v.odd == {c for c, x in v.known.items() if x in (None, (b"", b""))} and v.odd
