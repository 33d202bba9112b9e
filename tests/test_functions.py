from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loomline.functions import money, text
from loomline.functions import url as U


def _each(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


PRICES = {
    "126": None, "$126": "126", "Rs. 499": "499", "INR 499": "499", "price 126": None, "59.99": "59.99", "62,99 €": "62.99", "€17.000": "17000", "1.234,50 €": "1234.50", "$1,299.00": "1299.00",
    "-1": None, "-9.99": None, "$-1": None, "-$1": None, "-USD100": None, "": None, "none": None,
}


def test_prices(spark):
    assert dict(zip(PRICES, _each(spark, list(PRICES), money.price_text), strict=True)) == PRICES


def test_number_readers_differ(spark):
    assert _each(spark, ["1,299", "1,2999", "12.5"], money.lenient_float) == [1.299, 12999.0, 12.5]
    assert _each(spark, ["1,299", "a -3.5 b", None, "x"], money.first_number) == [Decimal("1.0000"), Decimal("-3.5000"), None, None]


def test_currency_and_availability(spark):
    assert _each(spark, ["Rs. 5", "€5", "CAD 5", "5"], money.currency) == ["INR", "EUR", "CAD", None]
    assert _each(spark, ["https://schema.org/InStock", "Unavailable", "only 3", "Pre-Order", "gone"], money.availability) == ["in_stock", "out_of_stock", "limited_stock", "pre_order", None]


@pytest.mark.parametrize(
    ("function", "cases"),
    [
        (U.domain_key, {"https://www.A.com:443/x": "a.com", "a.com/x": "a.com", "http://a.com:8080": "a.com:8080", "": ""}),
        (U.registrable_host, {"https://shop.a.co.uk/x": "a.co.uk", "http://x.y.a.com": "a.com", "http://10.0.0.1/": "10.0.0.1", "http://a.com": "a.com"}),
        (U.monitor_key, {"HTTPS://A.com/p/?q=1#f": "https://a.com/p", "http://a.com/": "http://a.com/"}),
        (U.strip_tracking, {"http://a.com/p?utm_source=x&id=2&gclid=1": "http://a.com/p?id=2", "http://a.com/p?ref=x": "http://a.com/p"}),
        (U.collapse_key, {"https://www.a.com/p/?size=3&b=2&a=1": "a.com/p?a=1&b=2"}),
        (U.terminal_text, {"http://a.com/c/red-wool_hat.html": "red wool hat"}),
        (text.field_key, {"Product Title": "product_title", "salePrice": "sale_price", "Care & Use": "care_use"}),
        (text.stem, {"running": "run", "boxed": "boxed", "painters": "paint", "ring": "ring"}),
        (text.strip_tags, {"<p>a<b>b</b></p><script>var t='</p>';</script>c &amp; d": "a b c & d"}),
    ],
)
def test_tables(spark, function, cases):
    assert dict(zip(cases, _each(spark, list(cases), function), strict=True)) == cases
