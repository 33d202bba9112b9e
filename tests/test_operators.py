from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomline.operators import admission, export, linkage, monitoring, quality, selection, taxonomy, variants


def test_snapshot_diff(spark):
    old = spark.createDataFrame([(1, "19.99", "Hat"), (2, "5", "Cap"), (3, "7", "Old")], "k int, price string, title string")
    new = spark.createDataFrame([(1, "17.49", " hat "), (2, "5.00", "Cap"), (4, "1", "New")], "k int, price string, title string")
    got = {tuple(r) for r in monitoring.snapshot_diff(old, new, "k", ["price", "title"]).collect()}
    assert got == {(1, "field_changed", "price", "19.99", "17.49"), (3, "record_removed", None, None, None), (4, "record_new", None, None, None), (2, "field_changed", "price", "5", "5.00")} or got == {
        (1, "field_changed", "price", "19.99", "17.49"), (3, "record_removed", None, None, None), (4, "record_new", None, None, None),
    }


@pytest.mark.parametrize(("rule", "met"), [("price >= 150", False), ("price < 150 AND availability == 'In Stock'", True), ("", True), ("availability != \"x\"", True), ("price != 1", True)])
def test_condition(spark, rule, met):
    row = spark.createDataFrame([("129.99", " in  stock ")], "p string, a string").select(monitoring.condition(rule, {"price": F.col("p"), "availability": F.col("a")}).alias("m")).first()
    assert row["m"] is met


@pytest.mark.parametrize("rule", ["price", "title == 'x'", "price >= 1; drop", "availability < 'x'"])
def test_condition_errors(rule):
    with pytest.raises(ValueError, match="."):
        monitoring.condition(rule, {})


def test_match_ladder(spark):
    rows = [("Acme 4-in-1 Cooker Deluxe", "Acme 3-in-1 Cooker Deluxe", 100.0, 100.0), ("Acme Cooker Deluxe Grey", "Acme Cooker Deluxe Grey", 100.0, 110.0)]
    df = spark.createDataFrame(rows, "a string, b string, p double, q double")
    sim = linkage.title_similarity(F.col("a"), F.col("b"))
    score, basis = linkage.ladder(F.col("sim"), F.lit(True), F.abs(F.col("p") - F.col("q")) <= 25, mismatch=linkage.spec_mismatch(F.col("a"), F.col("b")), source_type=F.lit("retailer"))
    got = df.withColumn("sim", sim).select("a", score.alias("s"), basis.alias("basis"), linkage.label(score).alias("l")).collect()
    assert got[0]["s"] <= 0.62 and got[0]["l"] != "high"
    assert got[1]["s"] >= 0.85 and got[1]["l"] == "high" and got[1]["basis"] == "brand+title"


def test_audit_cap(spark):
    scores = {"D-AID1": F.lit(0), "D-AID2": F.lit(100), "D-AID3": F.lit(100), "D-AID4": F.lit(100), "D-AID5": F.lit(100), "D-AID6": F.lit(100)}
    assert spark.range(1).select(quality.audit_score(scores).alias("s")).first()["s"] == 30
    assert sum(quality.AUDIT_WEIGHTS.values()) == pytest.approx(1)


def test_keywords(spark):
    df = spark.createDataFrame([("Navy Linen Dress", "Acme")], "t string, b string")
    got = df.select(taxonomy.keywords([F.col("t"), F.col("b")], F.col("t"), ["the"]).alias("k")).first()["k"]
    assert got == ["navy", "linen", "dress", "acme", "navy linen", "linen dress"]


def test_variants_merge(spark):
    v = "array<struct<id:string,sku:string,options:map<string,string>,price:string,stock:int>>"
    df = spark.createDataFrame([(1, [("a", None, {"size": "S"}, None, None), ("a", "s1", {"size": "S"}, "5", None), (None, None, None, None, 3)])], f"k int, variants {v}")
    got = sorted(((r["identity"], r["sku"], r["price"]) for r in variants.merged(df, "k").collect()), key=str)
    assert got == [("id:a", "s1", "5"), (None, None, None)]
    assert [tuple(r) for r in variants.axes(df, "k").collect()] == [(1, "size", ["S"])]


def test_export(spark):
    df = spark.createDataFrame([(1, {"a": "1", "_x": "2"}), (2, {"b": "3", "a": ""})], "id int, data map<string,string>")
    assert export.header(df) == ["a", "b"]
    assert sorted(tuple(r) for r in export.flat(df, ["id"]).collect()) == [(1, "1", ""), (2, "", "3")]
    stored = spark.createDataFrame([("k1", "f1"), ("k2", "f2")], "k string, f string")
    incoming = spark.createDataFrame([("k1", "f1"), ("k2", "f9"), ("k3", "f3"), (None, "f")], "k string, f string")
    assert {r["k"]: r["action"] for r in export.upserted(stored, incoming, "k", "f").collect()} == {"k1": "none", "k2": "update", "k3": "insert"}


def test_domains(spark):
    urls = ["http://a.com", "HTTPS://www.A.com/x", "http://a.com:80/", "http://a.com.evil.org/", "http://m.a.com/", "ftp://a.com/", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [bool(r[0]) for r in df.select(selection.of_domain(F.col("u"), F.lit("a.com"))).collect()] == [True, True, True, False, False, False, False]


def test_rule_values(spark):
    df = spark.createDataFrame([([("a", 1), ("b", 2), ("a", 3)],), ([],)], "v array<struct<id:string,n:int>>")
    first = selection.variant_value(F.col("v"), "n", lambda v: v["id"] == "a")
    every = selection.variant_values(F.col("v"), lambda v: v["id"], "n")
    assert [tuple(r) for r in df.select(first, every).collect()] == [(1, {"b": 2, "a": 3}), (None, {})]


def test_adapter_results(spark):
    rows = [("x", "u", "1", " "), ("x", "u", None, None), ("y", "u", "2", "b"), ("y", "w", None, "c"), ("y", None, "9", "z")]
    df = spark.createDataFrame(rows, "adapter string, url string, price string, title string")
    assert sorted(tuple(r) for r in selection.merged_results(df, "adapter", "url", ["price", "title"]).collect()) == [("u", "2", "b"), ("w", None, "c")]
    assert selection.merged_results(df.limit(0), "adapter", "url", ["price"]).collect() == []


def test_admission(spark):
    rows = [
        ("https://a.com/product/x", "Red Kettle AB12345", True),  # the code
        ("https://a.com/product/x", "Red Kettle CD99999", False),  # another code
        ("https://a.com/product/x", "Red Kettle", True),
        ("https://a.com/product/x", "Blue Garden Chair", False),
        ("https://a.com/category/x", "Red Kettle AB12345", False),
        ("https://a.com/red-kettle-two-litres", None, True),  # the URL stands for the text
        ("https://a.com", "Red Kettle", False),
        (None, "Red Kettle", False),
    ]
    df = spark.createDataFrame(rows, "url string, found string, expected boolean")
    may = admission.admitted(F.lit("Red Kettle"), F.lit("Acme"), F.lit("AB12345"), F.col("url"), F.col("found"))
    assert [(bool(r[0]), r[1]) for r in df.select(may, "expected").collect()] == [(e, e) for _, _, e in rows]


def test_axes_noise_scripts(spark):
    names = {"Colour": "color", "Select Size": "size", "Size & Color": "size_color", "shoe size 2": "size", "Pack count": "pack_count", "": "", None: ""}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(admission.axis_key(F.col("n"))).collect()] == list(names.values())
    noise = {"#abc": True, "#abcd": False, "Save 10%": True, "10% wool": False, " ": True, None: True, "N/A": True, "Blue": False}
    df = spark.createDataFrame([(n,) for n in noise], "n string")
    assert [r[0] for r in df.select(admission.option_noise(F.col("n"))).collect()] == list(noise.values())
    page = '<script src="a"></script><SCRIPT type="x" id=" i ">\n{1}</SCRIPT><template data-varname="S"><script>2</script></template>'
    df = spark.createDataFrame([(page,), ("",), (None,)], "h string")
    got = [[tuple(s) for s in r[0]] for r in df.select(admission.script_texts(F.col("h"))).collect()]
    assert got == [[("i", "x", "\n{1}"), ("S", "", "2")], [], []]
    rules = [("a", "p", F.lit(1)), ("", "p", F.lit(2)), (None, None, F.lit(None)), (" p ", "q", F.lit(3))]
    assert spark.range(1).select(admission.rule_values(rules)).first()[0] == {"a": "1", "p": "3", "rule_3": None}


def test_typed_values(spark):
    from loomline.operators import typed

    given = [
        ("price", '{"amount":"€ 1.234,50"}'), ("price", '"-5"'), ("price", '["n/a", 12.5]'), ("stock_quantity", "3.7"), ("stock_quantity", '"1,200"'), ("availability", "true"), ("availability", '"Only 3 left in stock"'), ("brand", '{"0":"x"}'),
        ("brand", '"https://x.com/a"'), ("gender", '"Womens"'), ("url", '"javascript:x"'), ("url", '{"href":"/a"}'), ("links", '["/b","/B","c"]'), ("features", '"a, b; A"'), ("rating", '"4.25 out of 5"'), ("sku", '"draft-AB1"'), ("remote", '"maybe"'), ("any_count", '"7"'), ("note", "not json"), ("note", None), ("note", "[]"),
    ]
    df = spark.createDataFrame([(k, f, v) for k, (f, v) in enumerate(given)], "id int, field string, value string")
    got = {r["id"]: (r["value"], r["values"]) for r in typed.coerced(df, ["id"], F.lit("https://s.com/x")).collect()}
    one = lambda v: (v, [v])
    assert got == {
        0: one("1234.50"), 2: one("12.5"), 4: one("1200"), 5: one("in_stock"), 6: one("limited_stock"), 9: one("women"), 11: one("https://s.com/a"), 12: ("https://s.com/b", ["https://s.com/b", "https://s.com/c"]),
        13: ("a", ["a", "b"]), 14: one("4.25"), 15: one("AB1"), 17: one("7"), 18: one("not json"),
    }
    assert typed.coerced(df.limit(0), ["id"]).count() == 0


def test_snapshots(spark):
    from loomline.operators import snapshots

    records = [({"title": "ACME Hat", "price": "$ 1,299.50", "url": "https://x.co.uk/1", "upc": "123456789012"}, ("ACME Hat", "ACME", "acme", 1299.5, "USD", "123456789012")), ({"name": " hat ", "sale_price": "-5", "currency": "eur", "source_url": "https://www.shop.com/a"}, ("hat", "shop", "shop", None, "EUR", None)), ({}, (None, None, "", None, None, None))]
    df = spark.createDataFrame([(k, r) for k, (r, _) in enumerate(records)], "k int, r map<string,string>")
    got = {r["k"]: tuple(r["s"][c] for c in ("title", "brand", "normalized_brand", "price", "currency", "gtin")) for r in df.select("k", snapshots.snapshot(F.col("r")).alias("s")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(records)}


def test_site_shells(spark):
    from loomline.operators import snapshots

    given = [
        ("Hat", "5", None, None, "https://s.com/p/1/p/2", "several_products"), ("Home", "5", None, None, "https://s.com/p/1", "title_noise"), (None, None, None, None, "https://s.com/p/1", "title_noise"), ("Hats", None, None, "b", "https://s.com/collections/hats", "list_url"),
        ("Hats", "5", None, None, "https://s.com/collections/hats", None), ("My Shop", None, None, "b", "https://myshop.com/x", "site_name"), ("Hat", None, None, None, "https://s.com/x", "title_only"), ("S", "5", "i", "d" * 200, "https://s.com/c/x", None), ("Hat", None, "i", None, "https://s.com/x", None),
    ]
    df = spark.createDataFrame([(k, *g[:5]) for k, g in enumerate(given)], "k int, title string, price string, image_url string, description string, url string")
    record = {c: F.col(c) for c in ("title", "price", "image_url", "description")}
    assert {r["k"]: r["why"] for r in df.select("k", snapshots.shell_reason(record, F.col("url")).alias("why")).collect()} == {k: g[5] for k, g in enumerate(given)}


def test_shared_codes(spark):
    from collections import Counter
    from itertools import combinations

    from loomline.operators import products

    given = [(k, [None, "", "all", "all", f"p{k // 2}", f"q{k % 7}"][: 3 + k % 4] + [f"r{k // 3}"] * (k % 5 > 1)) for k in range(60)] + [(60, None), (61, [])]
    df = spark.createDataFrame(given, "k int, codes array<string>")
    sets = {k: {c for c in codes or [] if c} for k, codes in given}
    want = Counter({(x, y): len(sets[x] & sets[y]) for x, y in combinations(sets, 2)})
    for least in (1, 2, 3):
        got = {(r["a"], r["b"]): r["shared"] for r in products.shared_codes(df, "k", F.col("codes"), least).collect()}
        assert got == {pair: n for pair, n in want.items() if n >= least} and got
    # a code of everything makes no pairs of rows where two codes are asked for
    hot = spark.range(30_000).select("id", F.array(F.lit(-1).cast("long"), F.expr("id div 2")).alias("codes"))
    assert products.shared_codes(hot, "id", F.col("codes"), 2).agg(F.count("*"), F.min("shared"), F.max(F.col("b") - F.col("a"))).first()[:] == (15_000, 2, 1)
