from __future__ import annotations

import base64
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomline.llm import bpe, common, decontaminate, line_dedup, pii, quality_model, quality_rules, rans, warc

from . import brute

SMALL, DATA = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
ODD = [None, "", " ", "\n\n", "a", "a  b\t\nc", "\x1c\x85　 d", "aaaa" * 3000, "🎉🎉 ñ́ 漢字 １２ ²", "don't I'll 've", "=" * 2000, "İstanbul ΣΑΣ ǅ", "<|endoftext|> x", "é" * 50, "\x00 ​ x"]


def odd_texts(n=200, seed=1):
    r = random.Random(seed)
    pick = lambda: chr(r.choice([r.randrange(32, 127), r.randrange(9, 40), r.randrange(0x80, 0x3000), r.randrange(0x10000, 0x1FFFF)]))
    return ODD + ["".join(pick() for _ in range(r.randrange(1, 40))) for _ in range(n)]


def rows_of(table, columns, path=SMALL):
    return duckdb.sql(f"select {columns} from read_parquet('{path}/{table}.parquet') order by 1").fetchall()


def test_bpe_equals_tiktoken(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "x", b"y") for i, t in enumerate([*texts, texts[5]])], "doc_id long, text string, n_tokens string, bytes binary").repartition(3)
    both = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path).collect()
    assert len(both) == len(texts) + 1
    for r in both:
        text = [*texts, texts[5]][r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == theirs.encode_ordinary(text)
        assert bytes(r["bytes"]) == text.encode() and r["n_tokens"] == len(r["ids"]) // 4
    assert bpe.encode(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_bpe_holds_one_worker_a_task(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(i, t, "x", b"y") for i, t in enumerate(odd_texts())], "doc_id long, text string, n_tokens string, bytes binary").repartition(3)
    both = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    once = bpe.encode(docs, path, public_tokenizers.PATTERN, bytes_col="bytes")
    assert sorted(once.select(both.columns).collect()) == sorted(both.collect())
    plan = bpe.digests(docs, path, public_tokenizers.PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"MapInArrow|MapInPandas|EvalPython", plan)) == 1


def test_rans_round_trip(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [*odd_texts(seed=2), "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|end oftext|>"]
    docs = spark.createDataFrame([(7 * i % 1009, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(3)
    rans.write_tokens(docs, path, str(tmp_path / "f"), end_id=1)
    got = {r["doc_id"]: (r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rans.read_tokens(spark, str(tmp_path / "f")).collect()}
    start = 0
    for doc, text in sorted((7 * i % 1009, t or "") for i, t in enumerate(texts)):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert got[doc] == (start, ids)
        start += len(ids)
    assert len(got) == len(texts)
    blocks = spark.read.parquet(str(tmp_path / "f/blocks"))
    blocks.withColumn("words", F.concat("words", F.lit(b"\0\0\0\0"))).write.parquet(str(tmp_path / "g/blocks"))
    spark.read.parquet(str(tmp_path / "f/table")).write.parquet(str(tmp_path / "g/table"))
    with pytest.raises(Exception, match="altered"):
        rans.read_tokens(spark, str(tmp_path / "g")).collect()
    rans.write_tokens(docs.limit(0), path, str(tmp_path / "e"), end_id=1)
    assert rans.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_rans_blocks():
    r = np.random.default_rng(1)
    blocks = [np.minimum(r.zipf(1.3, n), 40000).astype(np.uint16) for n in (1, 5, 64, 65, 70000, 40000)]
    model = rans.Model(rans.table(np.bincount(np.concatenate(blocks), minlength=1 << 16)))
    coded = model.encode(blocks)
    assert all((a == b).all() for a, b in zip(blocks, model.decode([c | {"n": len(b)} for c, b in zip(coded, blocks, strict=True)]), strict=True))


def test_archive(spark, tmp_path):
    long = "x" * 150
    pages = [(1, "u1", long), (2, "u\r\n2", long), (3, None, "short"), (4, "u4", "short"), (5, "u5", None), (None, "n", long), (6, "u6", "é" * 80)]
    warc.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1)), str(tmp_path / "a"))
    got = {r["page_id"]: r for r in warc.read_archive(spark, str(tmp_path / "a")).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("response", None)}
    for page, _, html in pages:
        payload = (html or "").encode()
        assert (got[page]["payload_bytes"], got[page]["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        head, _, block = bytes(got[page]["record"]).partition(b"\r\n\r\n")
        assert block == (b"" if got[page]["record_type"] == "revisit" else payload) + b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
    stored = spark.read.parquet(str(tmp_path / "a/payloads"))
    assert stored.count() == 4
    stored.withColumn("payload", F.lit(b"z")).write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="altered"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()


def test_quality_rules(spark, monkeypatch):
    docs = [(i, f"Unique words number{i} alpha beta gamma delta epsilon zeta eta theta {i}\nSubscribe to our  newsletter 12 today and every day please now yes", "h") for i in range(70)]
    docs += [(100 + i, "Subscribe to our  newsletter 99 today and every day please now yes\nshort", "h") for i in range(5)]
    docs += [(200, None, None), (201, "", "h"), (202, "a b c d e f a b c d e f a b c d e", "h"), (203, "é é\n é é\nb\nb\n\n", None), (204, "Subscribe to our  newsletter 12 today and every day please now yes\nbut on another host it stays here", "k")]
    docs.append(docs[0])
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, source string, kept string").repartition(3)
    got = quality_rules.judged(table).collect()
    want = brute.quality(docs)
    assert len(got) == len(docs)
    for r in got:
        text = next(t for d, t, _ in docs if d == r["doc_id"])
        assert tuple(r[m] for m in quality_rules.MEASURES) == brute.measures(text)
        assert (r["kept"], r["cleaned"]) == want[r["doc_id"]]
    assert {r["doc_id"]: r["kept"] for r in got}[0] and not {r["doc_id"]: r["kept"] for r in got}[100]
    monkeypatch.setattr(quality_rules, "BROADCAST_LINES", 0)
    key = lambda r: (str(r["doc_id"]), r["kept"], r["n_left"], r["cleaned"])
    assert sorted(map(key, quality_rules.judged(table).collect())) == sorted(map(key, got))
    columns = ["n_words", "text", "source", "kept", "n_chars"]
    stage = quality_rules.stage(spark, spark.createDataFrame([(d, t, h, "x", 1) for d, t, h in docs], "n_words long, text string, source string, kept string, n_chars int"), "")
    assert stage.columns == columns and {(r["n_words"], r["text"]) for r in stage.collect()} == {(d, t) for d, (ok, t) in want.items() if ok}
    assert quality_rules.judged(table.limit(0)).count() == 0


def test_quality_rules_of_a_long_text(spark):
    words = [f"w{k % 977}x{k}" for k in range(300_000)]
    long = " ".join(words[:150_000]) + "\n" + " ".join(words[150_000:]) + "\n" + " ".join(words[:7])
    row = quality_rules.judged(spark.createDataFrame([(1, long, "h")], "doc_id long, text string, source string")).first()
    assert tuple(row[m] for m in quality_rules.MEASURES) == brute.measures(long) and row["cleaned"] == long


def test_tiling_is_greedy():
    r = random.Random(3)
    for _ in range(150):
        item = [r.randrange(3) for _ in range(r.randrange(5, 40))]
        text = [r.randrange(3) for _ in range(r.randrange(0, 30))] + item[10:25] + [r.randrange(3) for _ in range(9)] + item[:8]
        assert sum(t[2] for t in decontaminate.tiles(item, text)) == brute.tiled(item, text)


@here
def test_decontamination_both_ways(spark, monkeypatch):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    first = bench.orderBy("item_id").first()["text"].split()
    half = len(first) // 2
    extra = [(9001, " ".join([*first[half:], "between", *first[:half]])), (9002, " ".join(first[: max(5, half // 2)])), (9003, None), (9004, " ".join(first).upper())]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    key = lambda df: sorted((r["doc_id"], r["item_id"], r["n_words"], r["n_matched"]) for r in df.collect())
    got = key(decontaminate.contaminated(docs, bench))
    assert {9001, 9004} <= {r[0] for r in got} and not {9002, 9003} & {r[0] for r in got}
    items = [r["text"] for r in bench.collect()]
    assert {r[0] for r in got} == {r["doc_id"] for r in docs.collect() if brute.contaminated(r["text"], items)}
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    assert key(decontaminate.contaminated(docs, bench)) == got
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_decontamination_of_odd_rows(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", most)
    item = "one two three four five six seven eight nine ten"
    rows = [(None, item), (None, "one two three four five"), (None, "six seven eight nine ten"), (1, item), (1, item), (1, "something else"), (2, None), (3, ""), (4, "w " * 50_000 + item), (5, "nothing of that kind in here at all")]
    docs = spark.createDataFrame([(*d, k) for k, d in enumerate(rows)], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(7, item), (7, item), (None, item), (8, None), (9, "one two")], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["item_id"], r["n_matched"]) for r in decontaminate.contaminated(docs, bench).collect())
    want = [(str(d), 7, n) for d, n in ((None, 10), (None, 5), (None, 5), (1, 10), (1, 10), (4, 10)) for _ in range(2)]
    assert got == sorted(want)
    bench.write.mode("overwrite").parquet(f"{common.shared_dir(spark)}/odd{most}/benchmark.parquet")
    kept = decontaminate.stage(spark, docs, f"{common.shared_dir(spark)}/odd{most}")
    assert kept.columns == docs.columns and sorted(r["item_id"] for r in kept.collect()) == [5, 6, 7, 9]


def test_workers_forget_the_vocabulary():
    coder = bpe.coder(b"YQ== 0", r"\w+")
    assert bpe.coder(b"YQ== 0", r"\w+") is coder
    common.forget()
    assert not bpe.coder.cache_info().currsize and not bpe.pieces.cache_info().currsize


def test_edit_distance(spark):
    r, pairs = random.Random(2), []
    for _ in range(300):
        a = [r.choice("abé😀") for _ in range(r.randrange(0, 14))]
        b = a[:]
        for _ in range(r.randrange(0, 5)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(2)] = [r.choice("abé😀")] * r.randrange(2)
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2):
        for row in df.select("a", "b", line_dedup.edit_distance(line_dedup.characters(F.col("a")), line_dedup.characters(F.col("b")), edits).alias("d")).collect():
            assert min(row["d"], edits + 1) == min(brute.levenshtein(row["a"], row["b"]), edits + 1)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_line_dedup_of_hot_keys(spark, monkeypatch, edits):
    """Lines that share keys with many others are met by deeper keys: no near line is lost, and far ones are not paired."""
    monkeypatch.setattr(line_dedup, "HOT_LINES", 1)
    r = random.Random(edits)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(1, 6)))
    bases, docs = [[word() for _ in range(n)] for n in (12, 13, 40)] + [list("".join(r.choice("abc") for _ in range(n))) for n in (22, 35)], []
    for k in range(140):
        units = r.choice(bases)[:]
        sign = word if units in bases[:3] else lambda: r.choice("abc")
        glue = " " if units in bases[:3] else ""
        for _ in range(r.randrange(0, 2 * edits + 2)):
            at = r.randrange(len(units))
            units[at : at + r.randrange(2)] = [sign()] * r.randrange(2)
        docs.append((k, glue.join(units)))
    got = {x["doc_id"]: (x["exact"], x["near"]) for x in line_dedup.removed(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), edits=edits).collect()}
    want = brute.lines_removed(docs, edits)
    assert got == want and sum(1 for _, near in want.values() if near) > 20
    words = [str(k) for k in range(40)]
    far = [words, *([*words[:k], "x", *words[k + 1 :]] for k in (0, 39)), [*words[:14], *"xyzvuwtsrqponmlkjihgfedcba"]]
    keys = [set(x) for (x,) in spark.createDataFrame([(" ".join(t),) for t in far], "t string").select(line_dedup.deep_keys(F.col("t"), 2, False)).collect()]
    assert keys[0] & keys[1] and keys[1] & keys[2] and not keys[0] & keys[3]


def test_hot_keys_with_few_lines_left_are_paired_directly(spark, monkeypatch):
    def unwanted(*_):
        raise AssertionError("deeper keys are not needed")

    monkeypatch.setattr(line_dedup, "HOT_LINES", 40)
    monkeypatch.setattr(line_dedup, "deep_keys", unwanted)
    words = [f"w{k}" for k in range(20)]
    docs = [(k, " ".join([*words[: 14 + k % 6], f"x{k}", *words[15 + k % 6 :]])) for k in range(60)]
    got = {x["doc_id"]: (x["exact"], x["near"]) for x in line_dedup.removed(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.lines_removed(docs, line_dedup.EDITS) and len(got) == 59


def test_exchanged_units_bound_the_edits(spark):
    r = random.Random(8)
    pairs = [("".join(r.choice("ab") for _ in range(r.randrange(9))), "".join(r.choice("ab") for _ in range(r.randrange(9)))) for _ in range(200)]
    units = [line_dedup.characters(F.col(c)) for c in "ab"]
    for row in spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.exchanged(*units).alias("n")).collect():
        assert row["n"] == sum(x != y for x, y in zip(row["a"], row["b"], strict=False)) + abs(len(row["a"]) - len(row["b"])) >= brute.levenshtein(row["a"], row["b"])


@pytest.mark.parametrize("edits", [1, 2])
def test_line_dedup(spark, edits):
    r = random.Random(edits)
    base = ["".join(r.choice("abcdé 😀") for _ in range(r.randrange(18, 40))) for _ in range(12)]
    docs = [(900, None), (901, ""), (902, "\n\n")]
    for k in range(50):
        lines = []
        for _ in range(4):
            line = list(r.choice(base))
            for _ in range(r.randrange(0, 4)):
                at = r.randrange(len(line))
                line[at : at + r.randrange(2)] = [r.choice("xyé")] * r.randrange(2)
            lines.append("".join(line))
        docs.append((k, "\n".join(lines)))
    got = {x["doc_id"]: (x["exact"], x["near"]) for x in line_dedup.removed(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, line int").repartition(3), edits=edits).collect()}
    assert got == brute.lines_removed(docs, edits)
    assert line_dedup.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cleaned_rows_without_an_id(spark):
    twice = "this line stands in two of the documents"
    docs = [(1, twice), (None, "first of its text, a line\n" + twice), (None, "something else altogether here\nand a second line that stands alone"), (7, "number seven has this line only"), (7, twice)]
    got = {(r["doc_id"], r["text"]) for r in line_dedup.cleaned(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {docs[0], (None, "first of its text, a line"), docs[2], docs[3]}


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_long_lines_by_words(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", broadcast)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(0, 9)))
    docs = [(None, "a line of a document without an id that stands after all others here"), (5000, "x " * 3000), (5001, "x " * 3000 + "y")]
    for k in range(15):
        words = [word() for _ in range(r.randrange(8, 60))]
        for c in range(6):
            other = words[:]
            for _ in range(r.randrange(0, 4)):
                at = r.randrange(len(other))
                other[at : at + r.randrange(2)] = [word()] * r.randrange(2)
            docs.append((10 * k + c, " ".join(other)))
    docs += docs[3:5]
    got = {x["doc_id"]: (x["exact"], x["near"]) for x in line_dedup.removed(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute.lines_removed([d for d in set(docs) if d[0] is not None])
    assert any(near for _, near in got.values()) and got[5001] == ([], [0])


def test_personal_data(spark):
    r = random.Random(4)
    parts = ["a", "b.", "@", "@", "1", "2", ".", ".", " ", "-", "+1", "%", "_", "4111111111111111", "é", "😀", "(", ")", "555", "﷐"]
    docs = [(-1, None), (-2, ""), (-3, "a@b.c_d@e.f.g x@y..z 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111﷐ +1 (988) 555-2485 é😀 a@b.co"), (-4, "1" * 30000), (-5, "a.b" * 20000 + "@c.d"), (-6, "1.2.3.4 " * 300), (-7, "a." * 20000 + "@" + "b." * 20000 + "c")]
    docs += [(k, "".join(r.choice(parts) for _ in range(r.randrange(1, 60)))) for k in range(300)]
    got = pii.redactions(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).select("doc_id", pii.joined("base").alias("base"), pii.joined("spans").alias("spans")).collect()
    texts = dict(docs)
    for row in got:
        assert row["base"] == brute.personal(texts[row["doc_id"]])
        assert set(filter(None, row["base"].split(","))) <= set(row["spans"].split(","))
    assert len(got) == len(docs)


def test_personal_data_that_no_rule_reads(spark):
    r = random.Random(6)
    luhn = lambda d: next(d + c for c in "0123456789" if sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d + c))) % 10 == 0)
    docs = []
    for k in range(200):
        card = luhn("".join(r.choice("0123456789") for _ in range(15)))
        ip = ".".join(str(r.randrange(1, 255)) for _ in range(4))
        docs.append((k, f"word w{k}.{k}@mail{k % 9}.example.com or {ip} of {card} and +1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)} end"))
    planted = {
        "email": "ana.7 (at) mail7 (dot) example (dot) com",
        "ip": "10[.]20[.]30[.]40",
        "card": "4111  1111  1111  1111",
        "phone": "(640) 555-0953",
    }
    docs += [(1000 + k, f"so {p} it is") for k, p in enumerate(planted.values())] + [(2000, "of 4111  1111  1111  1112 or 10[.]20[.]300[.]40 on 2024-01-15 12 it")]
    got = {row["doc_id"]: row for row in pii.redactions(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).select("doc_id", pii.joined("base").alias("base"), pii.joined("spans").alias("spans")).collect()}
    for k, (kind, span) in enumerate(planted.items()):
        assert got[1000 + k]["base"] == ""
        assert f"{kind}:3:{3 + len(span)}" in got[1000 + k]["spans"].split(",")
    assert got[2000]["spans"] == ""
    labels = {(row["kind"], row["label"]) for row in pii.labelled(pii.found(spark.createDataFrame([(1, "to a@mail7.example.com by")], "doc_id long, text string"))).select("s.kind", "label").collect()}
    assert labels == {("email", 1.0)}


@here
def test_classifier_on_held_out_rows(spark):
    labels = {r[0]: r[1] for r in rows_of("labels", "doc_id, quality", DATA)}
    got = quality_model.op10_quality_classifier(spark, DATA).collect()
    held = [r for r in got if r["doc_id"] in labels and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.95 * len(held) > 0


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, 2), (2, "", 3), (3, "some words", 4)], "doc_id long, text string, score int")
    model = quality_model.fit(docs, spark.createDataFrame([], "doc_id long, label int"))
    assert {r["score"] for r in quality_model.score(docs, model).collect()} == {0.5}


def test_classifier_learns_from_whole_texts(spark):
    docs = [(k, "same " * 5000 + ("good fine " if k % 2 else "bad poor ") * 3000) for k in range(40)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    amounts, _ = quality_model.fit(table, spark.createDataFrame([(k, k % 2) for k, _ in docs], "doc_id long, label int"))
    rows, counts = quality_model.counted(docs[1][1])
    _, theirs = quality_model.counted(docs[0][1])
    assert counts.sum() > 30000 and theirs.sum() > 30000
    ours = quality_model.score(spark.createDataFrame([(1, "good fine"), (2, "bad poor")], "doc_id long, text string"), (amounts, 0.0)).collect()
    scores = {r["doc_id"]: r["score"] for r in ours}
    assert scores[1] > 0.6 and scores[2] < 0.4


def test_classifier_chooses_among_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(quality_model, "SAMPLE_ROWS", 3)
    docs = [(1, f"text {k} of many words w{k}") for k in range(30)]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, label int")
    one, other = (quality_model.fit(spark.createDataFrame(d, "doc_id long, text string").repartition(n), labels)[0] for d, n in ((docs, 2), (docs[::-1], 5)))
    assert np.array_equal(one, other)


def test_trees_learn_from_all_candidates(spark, monkeypatch):
    seen, saved = [], common.saved

    def watched(df, name):
        out = saved(df, name)
        seen.extend([out.count()] if "label" in out.columns else [])
        return out

    monkeypatch.setattr(common, "saved", watched)
    docs = spark.range(410).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 10), k -> concat('at 10.', k, '.', id % 256, '.', id div 256, ' on')), ' ')").alias("text"))
    spans = pii.found(docs)
    pii.Judge(spans)
    rows = pii.labelled(spans)
    assert rows.where("s.kind = 'ip'").count() == 4100
    assert seen == [rows.select(F.explode(pii.views(F.col("s"), F.col("label"), F.col("weight")))).count()]
