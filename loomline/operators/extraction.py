"""Records from candidates: tiers, the public projection, payload paths, and backfills."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Tiers of sources, the strongest first.
TIERS = ["authoritative", "structured", "js_state", "dom", "text"]


def winners(candidates: DataFrame, key: str, multi: list[str] = ()) -> DataFrame:
    """key, field, value and tier of candidates (key, field, tier, ord, value): the first non-empty value of the strongest
    tier. Fields in multi keep all distinct values, the strongest tier first, joined by a line break."""
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    some = candidates.where(~text.is_empty(F.trim("value"))).withColumn("rank", F.when(rank > 0, rank).otherwise(len(TIERS) + 1))
    order = F.struct("rank", "ord", "value", "tier")
    first = some.groupBy(key, "field").agg(F.min(order).alias("b"), F.array_sort(F.collect_list(F.when(F.col("field").isin(list(multi)), order))).alias("all"))
    value = F.when(F.size("all") > 0, F.array_join(F.array_distinct(F.transform("all", lambda x: x["value"])), "\n")).otherwise(F.col("b.value"))
    return first.select(key, "field", value.alias("value"), F.col("b.tier").alias("tier"))


def record(won: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row a key with a column for each field."""
    return won.groupBy(key).agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields))


def public(df: DataFrame, key: str, allowed: dict[str, Column], others: list[str]) -> DataFrame:
    """key, data and rejected: allowed fields whose value has its shape (a predicate), and why the others are out. Checks
    go in order: private name, not allowed, empty, shape."""
    rows = []
    for name in [*allowed, *others]:
        value = F.col(name).cast("string")
        reason = F.lit("internal") if name.startswith("_") else F.lit("not_allowed") if name not in allowed else F.when(text.is_empty(value), "empty").when(~F.coalesce(allowed[name], F.lit(False)), "shape")
        rows.append(F.struct(F.lit(name).alias("k"), value.alias("v"), reason.alias("why")))
    listed = df.select(key, F.array(*rows).alias("r"))
    pick = lambda keep, part: F.map_from_entries(F.transform(F.filter("r", lambda x: x["why"].isNull() if keep else x["why"].isNotNull()), lambda x: F.struct(x["k"], x[part])))
    return listed.select(key, pick(True, "v").alias("data"), pick(False, "why").alias("rejected"))


def from_paths(payloads: DataFrame, body: str, paths: dict[str, list[str]]) -> DataFrame:
    """payloads with a column for each field: the first of its JSON paths that has a value."""
    parsed = payloads.withColumn("_v", F.try_parse_json(body))
    get = lambda p: F.try_variant_get("_v", p, "string")
    return parsed.select(*payloads.columns, *(text.first_present(*map(get, ps)).alias(f) for f, ps in paths.items()))


def from_roots(payloads: DataFrame, body: str, roots: list[str], paths: dict[str, list[str]]) -> DataFrame:
    """payloads with a column for each field: its first value below the roots of a page's state, root by root. Roots start with
    `$`, paths with a dot; what is not an object below a root, blank values and text that is no JSON give nothing."""
    return from_paths(payloads, body, {f: [root + p for root in roots for p in ps] for f, ps in paths.items()})


def backfilled(rows: DataFrame, other: DataFrame, keys: list[str], fields: list[str], place: str) -> DataFrame:
    """rows whose blank fields are filled from other, by the first of keys that finds a row; of other rows with one key
    the last by place counts."""
    out, found = rows, []
    for n, key in enumerate(keys):
        last = other.where(~text.is_empty(F.col(key).cast("string"))).groupBy(F.col(key).alias(f"_k{n}")).agg(F.max_by(F.struct(*fields), place).alias(f"_f{n}"))
        out = out.join(last, F.col(key) == F.col(f"_k{n}"), "left")
        found.append(F.col(f"_f{n}"))
    hit = F.coalesce(*found)
    return out.select(*(F.coalesce(F.when(~text.is_empty(F.col(c).cast("string")), F.col(c)), hit[c]).alias(c) if c in fields else F.col(c) for c in rows.columns))


def composed(saved: DataFrame, run: DataFrame, key: list[str], place: str) -> DataFrame:
    """Rules of a run before saved rules; one rule a key."""
    both = run.withColumn("_source", F.lit(0)).unionByName(saved.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("_source", F.desc(place))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_source")


def long_texts(values: Column, least: int = 200, suffix: int = 160) -> Column:
    """Texts in order without those that differ from a kept one only by a short end: both are `least` long, share a start
    of that length, and what follows the shared start is at most `suffix` long on either side. Joined by blank lines."""

    def shared(a: Column, b: Column) -> Column:
        n = F.least(F.length(a), F.length(b))
        # longest common start, by halving
        steps = F.sequence(F.lit(0), F.lit(20))
        return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(_halved(a, b, s)), lambda s: s["lo"])

    def same(a: Column, b: Column) -> Column:
        n = shared(F.lower(a), F.lower(b))
        return (F.lower(a) == F.lower(b)) | ((F.length(a) >= least) & (F.length(b) >= least) & (n >= least) & (F.length(a) - n <= suffix) & (F.length(b) - n <= suffix))

    kept = F.aggregate(F.filter(values, lambda v: ~text.is_empty(v)), F.slice(values, 1, 0), lambda acc, v: F.when(F.exists(acc, lambda k: same(v, k)), acc).otherwise(F.concat(acc, F.array(v))))
    return F.array_join(kept, "\n\n")


def _halved(a: Column, b: Column, s: Column) -> Column:
    middle = F.ceil((s["lo"] + s["hi"]) / 2).cast("int")
    return F.when(F.substring(a, 1, middle) == F.substring(b, 1, middle), F.struct(middle.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), (middle - 1).alias("hi")))


def union_ranked(frames: list[DataFrame], key: Column, most: int) -> DataFrame:
    """Ranked lists (column ord) one after the other; the first row of a key stays."""
    tagged = [f.withColumn("_list", F.lit(n)) for n, f in enumerate(frames)]
    both = reduce(DataFrame.unionByName, tagged).withColumn("_key", key)
    first = both.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("_list", "ord"))).where("_n = 1")
    return first.orderBy("_list", "ord").limit(most).drop("_n", "_key", "_list")
