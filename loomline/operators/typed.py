"""Values of fields by their kind: one dispatch over rows (field, value), where value is JSON of any shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as V
from ..functions import money
from ..functions import text as X

#: Kinds of fields; a field that is not named is `text`, one that ends with _count is `whole`.
KINDS = {
    "price": ["price", "sale_price", "original_price", "discount_amount"],
    "whole": ["review_count", "stock_quantity", "image_count", "position"],
    "rating": ["rating"],
    "currency": ["currency", "salary_currency"],
    "availability": ["availability"],
    "name": ["brand", "vendor", "company", "author", "category", "product_type", "title", "location"],
    "barcode": ["barcode", "gtin"],
    "sku": ["sku"],
    "gender": ["gender"],
    "url": ["url", "apply_url", "image_url"],
    "urls": ["additional_images", "links"],
    "option": ["color", "size", "material"],
    "texts": ["tags", "features", "available_sizes", "keywords"],
    "long_text": ["description", "specifications", "summary", "content"],
    "flag": ["remote", "featured"],
}
#: Where the value of an object stands, by kind, the first that is there.
OBJECT_KEYS = {
    "price": ["amount", "price", "value", "sale", "min", "lowPrice"],
    "whole": ["reviewCount", "ratingCount", "count", "totalCount", "numberOfReviews", "value"],
    "rating": ["ratingValue", "value", "rating", "score"],
    "currency": ["currency", "currencyCode", "priceCurrency", "salaryCurrency"],
    "availability": ["availability", "status", "value", "in_stock", "inStock"],
    "name": ["name", "title", "slug", "value", "label"],
    "url": ["url", "href", "src", "contentUrl"],
    "urls": ["url", "href", "src", "contentUrl"],
    "option": ["name", "title", "label", "value", "text"],
    "texts": ["name", "title", "label", "value", "text"],
}
#: Kinds whose value is a list; of other kinds the first element that gives a value counts.
LISTS = ["urls", "texts"]


def kind_of(field: Column) -> Column:
    out = F.when(field.endswith("_count"), "whole").otherwise("text")
    for kind, names in KINDS.items():
        out = F.when(field.isin(*names), kind).otherwise(out)
    return out


def _schema_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def _scalar(element: Column, kind: Column) -> Column:
    """The text of an element: its own, or for an object that of the kind's keys; null for what has none."""
    shape = _schema_of(element)
    from_object = F.lit(None).cast("string")
    for name, keys in OBJECT_KEYS.items():
        from_object = F.when(kind == name, F.coalesce(*(F.nullif(F.trim(F.try_variant_get(element, f"$.{k}", "string")), F.lit("")) for k in keys))).otherwise(from_object)
    return F.when(shape.startswith("OBJECT"), from_object).when(~shape.startswith("ARRAY"), F.try_variant_get(element, "$", "string"))


def _coerced(text: Column, kind: Column, base: Column) -> Column:
    """The value that a text has as one of a kind, as text; null where it has none."""
    clean = X.clean_text(text)
    state = F.when(F.lower(clean).isin("true", "1", "yes"), "in_stock").when(F.lower(clean).isin("false", "0", "no"), "out_of_stock").otherwise(F.coalesce(money.availability(F.regexp_replace(F.regexp_extract(clean, r"([^/]*)$", 1), r"(?<=[a-z])(?=[A-Z])", " ")), clean))
    plain = clean.rlike(r"^[-+]?\d+(?:\.\d+)?$")
    price = F.when(money.is_negative(clean), None).when(plain, clean).when(clean.rlike(r"\d"), money.canonical_number(clean))
    path = clean.rlike(r"^(?:https?:)?/{1,2}\S+$")
    value = (
        F.when(kind == "price", price)
        .when(kind == "whole", V.whole_number(F.when(F.replace(clean, F.lit(","), F.lit("")).rlike(r"^[-+]?\d+(?:\.0+)?$"), clean)).cast("string"))
        .when(kind == "rating", V.rating(F.regexp_extract(clean, r"^\d+(?:\.\d+)?", 0)).cast("string"))
        .when(kind == "currency", F.coalesce(money.currency(clean), F.when(clean.rlike("^[A-Za-z]{3}$"), F.upper(clean)), clean))
        .when(kind == "availability", state)
        .when(kind == "name", F.when(~path, clean))
        .when(kind == "barcode", V.barcode(F.regexp_replace(clean, r"^\[\s*['\"]?|['\"]?\s*\]$", "")))
        .when(kind == "sku", V.sku(clean))
        .when(kind == "gender", V.gender(clean))
        .when(kind.isin("url", "urls"), F.when(~clean.rlike(r"(?i)^(?:javascript|data|mailto|tel):"), V.absolute_url(base, clean)))
        .when(kind == "long_text", X.strip_tags(text))
        .when(kind == "flag", F.when(F.lower(clean).isin("true", "1", "yes"), "true").when(F.lower(clean).isin("false", "0", "no"), "false"))
        .otherwise(clean)
    )
    return F.nullif(value, F.lit(""))


def coerced(rows: DataFrame, keep: list[str], base: Column | None = None) -> DataFrame:
    """keep, field, kind, value and values of rows (keep, field, value as JSON text; text that is no JSON stands for itself).

    A list's elements count one by one, those of lists within it too, but no deeper; an object gives what stands under its kind's keys. value is the
    first that the kind takes; values are all of them for kinds of lists, each once without regard to case, in their order,
    else the one. Rows whose value the kind does not take are left out. keep and field name a row: rows of one name are
    elements of one value."""
    base = base if base is not None else F.lit("")
    parsed = F.coalesce(F.try_parse_json("value"), F.try_parse_json(F.to_json(F.array("value"))))
    v = rows.select(*keep, "field", kind_of(F.col("field")).alias("kind"), base.alias("_base"), F.row_number().over(Window.partitionBy(*keep, "field").orderBy("value")).alias("_row"), parsed.alias("_v")).where("_v IS NOT NULL")
    as_list = lambda c: F.coalesce(F.try_variant_get(c, "$", "array<variant>"), F.array(c))
    one = v.select("*", F.posexplode(as_list(F.col("_v"))).alias("_outer", "_e")).select("*", F.posexplode(as_list(F.col("_e"))).alias("_inner", "_x"))
    split = F.when(F.col("kind") == "texts", V.split_values(_scalar(F.col("_x"), F.col("kind")))).otherwise(F.array(_scalar(F.col("_x"), F.col("kind"))))
    texts = one.select(*keep, "field", "kind", "_base", "_row", "_outer", "_inner", F.posexplode(split).alias("_part", "_t"))
    found = texts.withColumn("_value", _coerced(F.col("_t"), F.col("kind"), F.col("_base"))).where("_value IS NOT NULL")
    order = F.struct("_row", "_outer", "_inner", "_part", F.col("_value").alias("value"))
    listed = F.transform(F.array_sort(F.collect_list(order)), lambda x: x["value"])
    out = found.groupBy(*keep, "field", "kind").agg(V.distinct_texts(listed).alias("values"))
    return out.select(*keep, "field", "kind", F.get("values", F.lit(0)).alias("value"), F.when(F.col("kind").isin(*LISTS), F.col("values")).otherwise(F.slice("values", 1, 1)).alias("values"))
