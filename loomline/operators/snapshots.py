"""Records of products in one shape, and records that are a site's shell and no product."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fields as V
from ..functions import money
from ..functions import text as X
from ..functions import url as U

#: Our own defaults: where a snapshot's fields are read, the first that is there.
FIELDS = {
    "title": ["title", "name", "product_name"], "brand": ["brand", "vendor", "manufacturer"], "price": ["sale_price", "price", "original_price"], "currency": ["currency", "price_currency"], "image_url": ["image_url", "image", "thumbnail"],
    "url": ["url", "source_url", "link"], "sku": ["sku", "part_number"], "mpn": ["mpn", "model_number"], "gtin": ["gtin", "barcode", "ean", "upc"], "style": ["style", "style_number"], "availability": ["availability", "stock_status"],
}
#: Our own defaults: titles that no product has, and paths of lists of products.
SHELL_TITLES = ["home", "page not found", "404", "access denied", "loading", "untitled", "shop", "search results"]
LIST_PATHS = r"/(?:c|category|categories|collections?|search|shop|brands?)(?:/[^/]+)?/?$"
PRODUCT_PARTS = r"/(?:p|product|products|item|dp)/"
IDENTITY = ["price", "brand", "sku", "gtin", "image_url", "availability", "description"]
LEAST_DESCRIPTION = 160


def snapshot(record: Column) -> Column:
    """A struct of FIELDS from a map of texts (null for what it lacks), with normalized_brand, price as a number, the currency
    that the price tells where none is given, and style_code from the numbers that are no barcode. A brand that is not given is
    the title's first word where it is all capitals, else the page's registrable name."""
    first = {name: F.coalesce(*(F.nullif(F.trim(F.try_element_at(record, F.lit(k))), F.lit("")) for k in keys)) for name, keys in FIELDS.items()}
    word = F.nullif(F.regexp_extract(F.coalesce(first["title"], F.lit("")), r"^([A-Z][A-Z0-9&]{2,})\b", 1), F.lit(""))
    site = F.nullif(F.regexp_extract(U.registrable_host(F.coalesce(first["url"], F.lit(""))), r"^([^.]+)\.", 1), F.lit(""))
    brand = F.coalesce(first["brand"], word, site)
    numbers = F.concat_ws(" ", first["sku"], first["style"], first["mpn"])
    other = {
        "brand": brand, "normalized_brand": X.brand(F.coalesce(brand, F.lit(""))), "price": F.when(~money.is_negative(first["price"]), money.lenient_float(first["price"])),
        "currency": F.coalesce(F.upper(first["currency"]), money.currency(first["price"])), "style_code": V.style_codes(numbers, first["gtin"]),
    }
    return F.struct(*((other | {k: v for k, v in first.items() if k not in other})[k].alias(k) for k in [*FIELDS, "normalized_brand", "style_code"]))


def shell_reason(record: dict[str, Column], url: Column) -> Column:
    """Why a detail record is its site's shell and no product, the first of these; null where it is a product:

    several products in the URL; a title that no product has, or none; a list's URL without a price; a title that is the
    site's name; nothing but a title, without a price, a picture and a description of LEAST_DESCRIPTION characters."""
    have = lambda name: F.trim(F.coalesce(record.get(name, F.lit(None)).cast("string"), F.lit(""))) != ""
    title = X.equality_text(F.coalesce(record["title"], F.lit("")))
    site = F.regexp_extract(U.registrable_host(url), r"^([^.]+)", 1)
    rich = have("price") & have("image_url") & (F.length(F.coalesce(record.get("description", F.lit(None)), F.lit(""))) >= LEAST_DESCRIPTION)
    some = F.lit(False)
    for name in IDENTITY:
        some = some | have(name)
    return (
        F.when(F.regexp_count(F.lower(U.path(url)), F.lit(PRODUCT_PARTS)) > 1, "several_products")
        .when((title == "") | title.isin(*SHELL_TITLES), "title_noise")
        .when(rich, None)
        .when(F.lower(U.path(url)).rlike(LIST_PATHS) & ~have("price"), "list_url")
        .when((site != "") & (F.regexp_replace(title, "[^a-z0-9]", "") == F.regexp_replace(site, "[^a-z0-9]", "")), "site_name")
        .when(~some, "title_only")
    )
