"""Personal data: rules, and gradient-boosted trees over wider candidates. DataFrame functions only.

Rules find e-mail addresses, IP addresses, payment cards and phone numbers; what they find stays. Generators of high recall
propose further spans, which may overlap: addresses with their signs spelt out, phone numbers without a plus, numbers in
groups, dotted numbers. Boosted trees judge these by format and context. The trees learn from all
candidates that have a label. A candidate that overlaps a span that its kind's rule
accepts is a positive; one that the rule can read and refuses, or that overlaps another kind's span, is a negative. Spellings
that the rules cannot read get half the weight and the label of their plain spelling, or none if that does not decide
(`labelled`). From each positive `views` derives spellings that the rules cannot read, as weak positives, and contrasts that
are no such data, as weak negatives, so that both classes are there even where all candidates are right. Features are of the
plain spelling, and the rule's own trigger (the plus, the @) is none, so that spellings without it can score alike. A fifth
of them (a candidate with all its views) calibrates each kind's threshold: the least score from which PRECISION of the
accepted are positives. The fitted trees become a column expression, so that scoring needs no shuffle.

Regular expressions are written so that Java's engine neither recurses nor starts again within a run of characters: a
separator between two fitting characters first becomes a mark that no class else has, and repeated groups become one
class. Long texts of digits or letters take linear time.

Cases: null and empty texts have no spans. A text that has the mark itself is read with another character in its place.
Repeated rows have equal results. A kind without a positive, or without one in its held-out fifth, adds no spans. Other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
PRECISION, WEAK = 0.98, 0.5
TREES, DEPTH, SEED = 8, 3, 5
_MARK, _OTHER = "﷐", "﷑"  # not characters

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: Signs spelt out, in brackets or as words.
_AT, _DOT = r" ?[(\[](?i:at|@)[)\]] ?| (?i:at) ", r" ?[(\[](?i:dot|\.)[)\]] ?| (?i:dot) "
#: kind -> (separator that becomes a mark, pattern). Equal to the rules of the kinds, see the module's text.
_RULES = {
    "email": (rf"(?<=[{_LABEL}])\.(?=[{_LABEL}])", rf"(?:\G|(?<![{_MARK}{_LOCAL}]))[{_MARK}{_LOCAL}]++@[{_LABEL}]++{_MARK}[{_MARK}{_LABEL}]++"),
    "ip": (None, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"(?<=[0-9])[\x20-](?=[0-9])", rf"[0-9][0-9{_MARK}]++"),
    "phone": (None, r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Generators: wider than the rules, bounded in length.
_WIDER = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}(?:@|{_AT})[{_LABEL}]{{1,63}}(?:(?:\.|{_DOT})[{_LABEL}]{{1,63}}){{0,7}}(?:\.|{_DOT})[{_LABEL}]{{2,63}}",
    "ip": rf"(?<![0-9.])[0-9]{{1,4}}(?:(?:\.|{_DOT})[0-9]{{1,4}}){{3}}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[0-9 -]{12,22})[0-9](?![0-9])",
    "phone": r"(?<![0-9])[+(]?[0-9][0-9().\x20-]{7,20}[0-9](?![0-9])",
}
_PREFILTER = {
    "email": rf"@|[(\[](?i:at)[)\]]| (?i:at) [{_LABEL}]{{1,63}}(?:\.|{_DOT})",
    "ip": rf"[0-9](?:\.|{_DOT})[0-9]",
    "card": r"[0-9][0-9 -]{12}",
    "phone": r"[0-9][0-9().\x20-]{8}",
}
FEATURES = ("chars", "digits", "spaces", "dashes", "dots", "brackets", "letters", "groups", "longest_group", "luhn", "big_parts", "before_letter", "after_letter", "before_dash", "after_dash", "word_signs", "last_label")
_SPAN = "array<struct<kind:string,start:int,end:int,match:string,before:string,after:string>>"


def _spans(text: F.Column, shown: F.Column, pattern: str, kind: str) -> F.Column:
    """Non-overlapping matches, from the left, with places in code points. shown has the same length as text."""
    state = "struct<at:int,found:array<struct<kind:string,start:int,end:int,match:string,before:string,after:string>>>"
    pieces, matches = F.split(shown, pattern, -1), F.regexp_extract_all(shown, F.lit(pattern), 0)

    def step(acc: F.Column, pair: F.Column) -> F.Column:
        start = acc["at"] + F.char_length(pair["piece"])
        end = start + F.char_length(pair["match"])
        found = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.substring(text, start + 1, end - start).alias("match"), F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise("").alias("before"), F.substring(text, end + 1, F.lit(1)).alias("after"))
        return F.struct(end.alias("at"), F.when(pair["match"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(found))).alias("found"))

    pairs = F.arrays_zip(pieces.alias("piece"), matches.alias("match"))
    empty = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), _SPAN).alias("found")).cast(state)
    return F.aggregate(pairs, empty, lambda a, p: step(a, p).cast(state), lambda a: a["found"])


def _digits(c: F.Column) -> F.Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: F.Column) -> F.Column:
    reverse = F.split(F.reverse(digits), "")
    numbers = F.transform(F.filter(reverse, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, match: F.Column) -> F.Column:
    digits = _digits(match)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.char_length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.char_length(digits).between(10, 15)
    return F.lit(True)


def _passing(kind: str):
    return lambda s: _passes(kind, s["match"])


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (spans that the rules accept) and wider (candidates), by kind as listed and place."""
    text = F.translate(common.text_column(docs, text_col), _MARK, _OTHER)
    out = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    none = F.from_json(F.lit("[]"), _SPAN)
    base, wider = [], []
    for kind in KINDS:
        mark, pattern = _RULES[kind]
        shown = F.regexp_replace("_text", mark, _MARK) if mark else F.col("_text")
        likely = F.col("_text").rlike({"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}[kind])
        base.append(F.when(likely, F.filter(_spans(F.col("_text"), shown, pattern, kind), _passing(kind))).otherwise(none).alias(f"base_{kind}"))
        wider.append(F.when(F.col("_text").rlike(_PREFILTER[kind]), _spans(F.col("_text"), F.col("_text"), _WIDER[kind], kind)).otherwise(none).alias(f"wider_{kind}"))
    out = out.select("doc_id", *base, *wider)
    return out.select("doc_id", F.concat(*(F.col(f"base_{k}") for k in KINDS)).alias("base"), F.concat(*(F.col(f"wider_{k}") for k in KINDS)).alias("wider"))


def plain(s: F.Column) -> F.Column:
    """The span with signs for words, single separators and no plus."""
    signs = lambda c: F.regexp_replace(c, _DOT, ".")
    kind, match = s["kind"], s["match"]
    return F.when(kind == "email", signs(F.regexp_replace(match, _AT, "@"))).when(kind == "ip", signs(match)).when(kind == "card", F.regexp_replace(match, "([ -])[ -]+", "$1")).otherwise(F.regexp_replace(match, r"^\+", ""))


def features(s: F.Column) -> list[F.Column]:
    """FEATURES of a span; none tells the rule's trigger."""
    match = plain(s)
    count = lambda pattern: F.regexp_count(match, F.lit(pattern)).cast("double")
    groups = F.filter(F.split(match, "[^0-9]+"), lambda g: g != "")
    big = F.size(F.filter(groups, lambda g: F.coalesce(F.substring(g, 1, 9).cast("int"), F.lit(0)) > 255))
    letter = lambda c: F.when(c.rlike(r"[\p{L}\p{N}_]"), 1.0).otherwise(0.0)
    dash = lambda c: F.when(c.rlike(r"[-./:=]"), 1.0).otherwise(0.0)
    return [
        F.char_length(match).cast("double"), count("[0-9]"), count(" "), count("-"), count(r"\."), count("[()]"), count("[A-Za-z]"),
        F.size(groups).cast("double"), F.coalesce(F.array_max(F.transform(groups, F.char_length)), F.lit(0)).cast("double"),
        F.when(_luhn(_digits(match)), 1.0).otherwise(0.0), big.cast("double"), letter(s["before"]), letter(s["after"]), dash(s["before"]), dash(s["after"]),
        F.regexp_count(s["match"], F.lit(r" (?i:at|dot) ")).cast("double"), F.char_length(F.regexp_extract(match, "[A-Za-z]*$", 0)).cast("double"),
    ]


def labelled(spans: DataFrame) -> DataFrame:
    """s (a candidate), label and weight, of the candidates that have a label."""
    rows = spans.where(F.size("wider") > 0).select("base", F.explode("wider").alias("s"))
    s = F.col("s")
    met = lambda same: F.exists("base", lambda b: ((b["kind"] == s["kind"]) if same else (b["kind"] != s["kind"])) & _overlaps(b, s))
    kind, match = s["kind"], plain(s)
    spelt, fits = match != s["match"], F.coalesce(*(F.when(kind == k, _passes(k, match)) for k in KINDS))
    like_phone = match.rlike(r"^(?:[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{4}$")
    own = (
        F.when((kind == "email") & s["match"].rlike(r"[(\[]"), 1.0)  # words in prose decide nothing
        .when(kind.isin("ip", "card") & fits & spelt, 1.0)
        .when(kind.isin("ip", "card", "phone") & ~fits, 0.0)
        .when((kind == "phone") & ~s["match"].startswith("+") & like_phone, 1.0)
    )
    label = F.when(met(True), 1.0).when(met(False), 0.0).otherwise(own)
    weight = F.when(met(True) | met(False) | (own == 0.0), 1.0).otherwise(WEAK)
    return rows.select("s", label.alias("label"), weight.alias("weight")).where("label IS NOT NULL")


def views(s: F.Column, label: F.Column, weight: F.Column) -> F.Column:
    """The candidate itself, and what a positive gives: spellings that its rule cannot read, and contrasts."""
    kind, match, digits = s["kind"], plain(s), _digits(s["match"])
    view = lambda m, y, w: F.struct(F.struct(kind.alias("kind"), m.alias("match"), s["before"].alias("before"), s["after"].alias("after")).alias("s"), (F.lit(y) if isinstance(y, float) else y).alias("label"), (F.lit(w) if isinstance(w, float) else w).alias("weight"))
    letters = lambda c: F.regexp_replace(c, "[^A-Za-z]", "")
    name, host = letters(F.substring_index(match, "@", 1)), letters(F.substring_index(match, "@", -1))
    national = F.regexp_replace(match, "^[0-9]{1,3}[ .-](?=.{10})", "")
    part = lambda a, n: F.substring(digits, a, n)
    more = {
        "email": [view(F.replace(F.replace(match, F.lit("@"), F.lit(" at ")), F.lit("."), F.lit(" dot ")), 1.0, WEAK), view(F.concat(name, F.lit(" at "), host, F.lit(" dot "), name), 0.0, WEAK)],
        "ip": [view(F.concat(F.lit("7"), F.lpad(F.substring_index(match, ".", 1), 2, "0"), F.lit("."), F.substring_index(match, ".", -3)), 0.0, WEAK)],
        "card": [view(F.concat(F.substring(match, F.lit(1), F.char_length(match) - 1), ((F.substring(match, -1, 1).cast("int") + 1) % 10).cast("string")), 0.0, WEAK)],
        "phone": [view(national, 1.0, WEAK), view(F.replace(F.regexp_replace(national, "[()]", ""), F.lit(" "), F.lit("-")), 1.0, WEAK), view(F.concat(part(1, 4), F.lit("-"), part(5, 2), F.lit("-"), part(7, 2), F.lit(" "), part(1, 2)), 0.0, WEAK), view(digits, 0.0, WEAK)],
    }
    itself = F.array(view(s["match"], label, weight))
    out = itself
    for k, others in more.items():
        out = F.when((label == 1.0) & (kind == k), F.concat(itself, F.array(*others))).otherwise(out)
    return out


def _overlaps(a: F.Column, b: F.Column) -> F.Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


class Judge:
    """Fitted trees and thresholds of each kind, as a column expression."""

    def __init__(self, spans: DataFrame):
        rows = labelled(spans).withColumn("h", F.xxhash64("s"))
        seen = common.saved(rows.select("h", F.inline(views(F.col("s"), F.col("label"), F.col("weight")))).select(F.col("s.kind").alias("kind"), "label", "weight", "h", *(c.alias(n) for c, n in zip(features(F.col("s")), FEATURES, strict=True))), "seen")
        self.trees: dict[str, list] = {}
        self.least: dict[str, float] = {}
        learn, check = seen.where("pmod(h, 5) <> 0"), seen.where("pmod(h, 5) = 0")
        classes = {r["kind"]: r for r in learn.groupBy("kind").agg(F.sum("label").alias("yes"), F.count("*").alias("n")).collect()}
        for kind in KINDS:
            have = classes.get(kind)
            if have is None or not 0 < have["yes"] < have["n"]:
                continue  # nothing to tell apart: no trees, so no spans are added
            vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(learn.where(F.col("kind") == kind).orderBy("h", "label", *FEATURES))
            model = GBTClassifier(labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=SEED).fit(vectors)
            self.trees[kind] = [(w, _tree(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees, strict=True)]
            # a row a score: few, as the trees have few leaves
            scored = check.where(F.col("kind") == kind).groupBy(self._score(kind, [F.col(n) for n in FEATURES]).alias("z")).agg(F.sum("label").alias("yes"), F.count("*").alias("n")).orderBy(F.desc("z")).collect()
            yes, n, least = 0.0, 0, float("inf")
            for r in scored:
                yes, n = yes + r["yes"], n + r["n"]
                if yes >= PRECISION * n:
                    least = r["z"]
            self.least[kind] = least

    def _score(self, kind: str, columns: list[F.Column]) -> F.Column:
        return reduce(lambda a, b: a + b, [F.lit(w) * _expression(t, columns) for w, t in self.trees[kind]])

    def _judged(self, kind: str):
        return lambda f: self._score(kind, [f[n] for n in FEATURES]) >= self.least[kind]

    def accepts(self, s: F.Column) -> F.Column:
        out = F.lit(False)
        for kind in self.trees:
            if self.least[kind] != float("inf"):
                # a let-binding: else the trees would compute the features anew
                bound = F.array(F.struct(*(c.alias(n) for c, n in zip(features(s), FEATURES, strict=True))))
                out = F.when(s["kind"] == kind, F.exists(bound, self._judged(kind))).otherwise(out)
        return out


def _tree(node) -> tuple | float:
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    return int(node.split().featureIndex()), float(node.split().threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def _expression(tree: tuple | float, columns: list[F.Column]) -> F.Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, threshold, low, high = tree
    return F.when(columns[feature] <= threshold, _expression(low, columns)).otherwise(_expression(high, columns))


def redactions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans: the rules' spans, and with them the candidates that the trees accept and that touch none."""
    spans = common.saved(found(docs, id_col, text_col), "spans")
    judge = Judge(spans)
    added = F.filter("wider", lambda s: judge.accepts(s) & ~F.exists("base", lambda b: _overlaps(s, b)))
    ordered = lambda c: F.array_sort(c, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(F.array_position(F.lit(list(KINDS)), a["kind"]) - F.array_position(F.lit(list(KINDS)), b["kind"])).cast("int"))
    return spans.select("doc_id", ordered(F.col("base")).alias("base"), ordered(F.when(F.size("wider") > 0, F.concat("base", F.array_distinct(added))).otherwise(F.col("base"))).alias("spans"))


def joined(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = redactions(common.read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return out.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
