"""Line dedup by a segment-partition edit join. DataFrame functions only.

A line goes if an equal line stands before it in the corpus (by document id, then line), or if a line before it is within
EDITS edits of it. Lines of WORDS words or more (between single spaces) are compared word by word, shorter ones character by
character, each with their like. Lines under LEAST_CHARS characters stay.

Equal lines are folded first, with partial aggregation. Each distinct line is cut into EDITS + 1 even segments; of two lines
within EDITS edits, one has a segment of the other unchanged, nearly in its place. So each line writes the keys (length,
segment, what stands there) of its own segments, and of the pieces that could be a segment of a line up to EDITS shorter, at
the places that the edits left over on either side allow. Lines that share a key are paired if their lengths and their
counts of letters, or of words by hash, are close enough, first with the earliest line of the key, then, if that is not
near, with all. Where over HOT_LINES lines share a key, and over a quarter of that many are left, the second round pairs
those that share a deeper one instead: of two lines within EDITS edits, all but EDITS of 2 * EDITS + 1 even segments of one
stand unchanged in the other, nearly in their places, so that no pair is lost. A banded bit-parallel edit distance decides
each pair that has more than EDITS units exchanged.

Only keys and places are shuffled for all lines. The texts of lines that share a key are fetched by their hashes, which
are broadcast up to BROADCAST_LINES of them, and met by a shuffle beyond that.

Cases: null and empty texts have no lines to remove. Very long texts and lines take part whole. Lines are compared as they
are, white space included. Rows without an id come last. Rows that repeat an id count as one document in `removed`;
`cleaned` takes from each text the lines that were found in it. Ties cannot occur, as places differ; equal lines at one
place of repeated rows are one line. Empty tables give no rows. Other columns are kept by `cleaned`, ignored otherwise.
"""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

EDITS, LEAST_CHARS, WORDS = 2, 20, 12
HOT_LINES = 256
BROADCAST_LINES = 2_000_000
_LETTERS = "eatnrioshdlu"
_LAST = "1" + "0" * 37


def _place(doc: F.Column, line: F.Column) -> F.Column:
    """Document and line as one number; documents without an id come last."""
    high = doc.cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)")
    return F.coalesce(high, F.lit(_LAST).cast("decimal(38,0)")).cast("decimal(38,0)") + line


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row (hash of the text), line (number), h1 and h2 (of the content) and content of the lines long enough."""
    text = common.text_column(docs, text_col)
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("line", "content"))
    lines = lines.where(F.char_length("content") >= LEAST_CHARS)
    return lines.select("doc_id", "row", "line", F.xxhash64("content").alias("h1"), F.xxhash64(F.lit(1), "content").alias("h2"), "content")


# --- segments ----------------------------------------------------------------------------------------------------


def pieces(edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter, segment, shift) of the pieces of a line that may be a segment of a line as long or shorter. Segment i
    of edits + 1 in a line of n units begins at i * n div (edits + 1); all pieces lie within a line of 2 * edits + 1 units."""
    if 2 * edits >= min(WORDS, LEAST_CHARS):
        raise ValueError("too many edits for the shortest lines")
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            out += [(less, i, shift) for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)]
    return out


def with_keys(lines: DataFrame, edits: int) -> DataFrame:
    """lines with `keys`, of the words of a line if it has WORDS or more, else of its characters."""
    parts = edits + 1

    def piece(less: int, i: int, shift: int) -> F.Column:
        n = f"(size(words) - {less})"
        start, end = f"{i} * {n} div {parts}", f"{i + 1} * {n} div {parts}"
        return F.expr(f"xxhash64('words', {n}, {i}, slice(words, CAST({start} + {shift} + 1 AS INT), CAST({end} - {start} AS INT)))")

    # a short line's pieces are one small lambda; with it Spark compiles this projection in small methods, where it would else
    # put the twelve pieces by words, which are most of the work, into one that the JVM does not compile
    listed = ", ".join(f"named_struct('less', {less}, 'i', {i}, 'shift', {shift})" for less, i, shift in pieces(edits))
    start, end = (f"{i} * (chars - p.less) div {parts}" for i in ("p.i", "(p.i + 1)"))
    by_characters = f"transform(array({listed}), p -> xxhash64('characters', chars - p.less, p.i, substring(content, CAST({start} + p.shift + 1 AS INT), CAST({end} - {start} AS INT))))"
    split = lines.withColumns({"words": F.transform(F.split("content", " ", -1), lambda w: F.xxhash64(w)), "chars": F.char_length("content")})
    return split.withColumn("keys", F.when(_by_word(F.col("content")), F.array(*(piece(*p) for p in pieces(edits)))).otherwise(F.expr(by_characters)))


def deep_pieces(edits: int, own: bool) -> list[tuple[int, int, tuple[tuple[int, int, int], ...]]]:
    """(which segments are left out, how much shorter the cut line is, runs of the others: from, to, shift), of the line
    that is cut itself with own, else of lines within edits of it. Edits lie in the segments left out; they change the
    shift of what stands behind them."""
    parts, out = 2 * edits + 1, set()
    for k, gone in enumerate(combinations(range(parts), edits)):
        bounds = (-1, *gone, parts)
        for behind in [(0,) * edits] if own else product(range(-edits, edits + 1), repeat=edits):
            shifts = (0, *behind)
            if sum(abs(b - a) for a, b in zip(shifts, behind, strict=False)) <= edits:
                out.add((k, shifts[-1], tuple((bounds[j] + 1, bounds[j + 1], shifts[j]) for j in range(edits + 1) if bounds[j] + 1 < bounds[j + 1])))
    return sorted(out)


def deep_keys(content: F.Column, edits: int, own: bool) -> F.Column:
    """Keys of deep_pieces. One of a line's own keys is among the keys of each line within edits of it."""
    parts = 2 * edits + 1
    run = lambda a, b, shift: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(shift).alias("shift"))
    listed = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(less).alias("less"), F.array(*(run(*r) for r in runs)).alias("runs")) for k, less, runs in deep_pieces(edits, own)))

    def key(line: F.Column, p: F.Column) -> F.Column:
        n = F.size(line["units"]) - p["less"]
        at = lambda segment: F.floor(segment * n / parts).cast("int")
        kept = F.transform(p["runs"], lambda r: F.slice(line["units"], F.greatest(at(r["a"]) + r["shift"], F.lit(0)) + 1, at(r["b"]) - at(r["a"])))
        return F.xxhash64(line["by_word"], n, p["k"], kept)

    # a let-binding: else each key would hash the units anew
    line = F.struct(F.transform(units(content), lambda w: F.xxhash64(w)).alias("units"), _by_word(content).alias("by_word"))
    return F.element_at(F.transform(F.array(line), lambda x: F.transform(listed, lambda p: key(x, p))), 1)


def _by_word(content: F.Column) -> F.Column:
    return F.octet_length(content) - F.octet_length(F.replace(content, F.lit(" "), F.lit(""))) >= WORDS - 1


def units(content: F.Column) -> F.Column:
    """The words or characters that the edits of a line count."""
    return F.when(_by_word(content), F.split(content, " ", -1)).otherwise(characters(content))


def _letters(content: F.Column, letters: str) -> F.Column:
    """Counts of letters, ten bits each, saturating."""
    packed = F.lit(0).cast("long")
    for letter in letters:
        count = F.least(F.lit(1023), F.octet_length(content) - F.octet_length(F.replace(content, F.lit(letter), F.lit(""))))
        packed = F.shiftleft(packed, 10).bitwiseOR(count.cast("long"))
    return packed


def _words(content: F.Column, side: int, fields: int) -> F.Column:
    """Counts of the words of either half of the hashes by their hash, ten bits each; null where a count might not fit."""
    hashes = F.transform(F.split(content, " ", -1), lambda w: F.xxhash64(w))
    one = lambda h: F.element_at(F.array(*(F.lit(1 << 10 * k).cast("long") for k in range(fields))), (F.pmod(F.shiftright(h, 1), F.lit(fields)) + 1).cast("int"))
    mine = lambda h: h.bitwiseAND(F.lit(1).cast("long")) == side
    return F.when(F.size(hashes) < 1024, F.aggregate(F.filter(hashes, mine), F.lit(0).cast("long"), lambda total, h: total + one(h)))


def _apart(a: F.Column, b: F.Column, letters: int) -> F.Column:
    """Sum of the differences of packed counts."""
    field = lambda c, k: F.shiftright(c, 10 * k).bitwiseAND(F.lit(1023))
    total = F.lit(0).cast("long")
    for k in range(letters):
        total = total + F.abs(field(a, k) - field(b, k))
    return total


# --- edit distance -----------------------------------------------------------------------------------------------


def edit_distance(a: F.Column, b: F.Column, edits: int) -> F.Column:
    """Edit distance of two arrays of characters if it is at most `edits`, else a larger number.

    A band of 2 * edits + 1 rows around the diagonal is held as bits of vertical differences, and moves down a row with
    each character of b; the last bit's row is followed down the diagonal to the end of a, then along it.
    """
    # a let-binding: else the steps would compute the arrays anew
    bound = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda p: _banded(p["a"], p["b"], edits))
    return F.element_at(bound, 1)


def exchanged(a: F.Column, b: F.Column) -> F.Column:
    """Places where the arrays differ, those past the end of the shorter one included: an upper bound of the edit distance."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: ~same))


def _banded(a: F.Column, b: F.Column, edits: int) -> F.Column:
    width = 2 * edits + 1
    ones = (1 << width) - 1
    rows, columns = F.size(a), F.size(b)
    inverse = lambda c: c.bitwiseXOR(F.lit(ones).cast("long"))

    def step(state: F.Column, j: F.Column) -> F.Column:  # j: 0-based column
        vp, vn = state["vp"], state["vn"]
        same = F.lit(0).cast("long")
        for k in range(width):  # bit k is row j + 1 - edits + k, 1-based
            at = j - edits + k
            same = same.bitwiseOR(F.when((at >= 0) & (at < rows) & (F.get(a, at) == F.get(b, j)), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
        d0 = (same.bitwiseAND(vp) + vp).bitwiseAND(F.lit(ones).cast("long")).bitwiseXOR(vp).bitwiseOR(same).bitwiseOR(vn)
        return F.struct(d0.alias("d0"), vp.alias("vp"), vn.alias("vn"), state["far"].alias("far"), j.alias("j"))

    def close(s: F.Column) -> F.Column:
        d0, vp, vn, j = s["d0"], s["vp"], s["vn"], s["j"]
        hp = vn.bitwiseOR(inverse(d0.bitwiseOR(vp)))
        hn = d0.bitwiseAND(vp)
        low = F.shiftright(d0, 1)
        past = j - (rows - edits)  # columns since the band's last row passed the end of a
        mask = F.when(past >= 0, F.lit(width - 2) - past).otherwise(F.lit(width - 1))
        on = lambda c: F.when(_has(c, mask, width), 1).otherwise(0)
        far = s["far"] + F.when(past < 0, 1 - on(d0)).otherwise(on(hp) - on(hn))
        return F.struct(hn.bitwiseOR(inverse(low.bitwiseOR(hp))).alias("vp"), low.bitwiseAND(hp).alias("vn"), far.cast("int").alias("far"))

    start = F.struct(F.lit(ones & ~((1 << edits) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(F.lit(edits), rows).cast("int").alias("far"))
    # a let-binding: the step's d0 is named before it is used several times
    bind = lambda state, j: F.element_at(F.transform(F.array(step(state, j)), close), 1)
    walked = F.aggregate(F.sequence(F.lit(0), columns - 1), start, bind, lambda s: s["far"])
    return F.when(F.abs(rows - columns) > edits, F.lit(edits + 1)).when((rows == 0) | (columns == 0), F.greatest(rows, columns)).otherwise(walked)


def _has(c: F.Column, place: F.Column, width: int) -> F.Column:
    out = F.lit(False)
    for k in range(width):
        out = F.when(place == k, c.bitwiseAND(F.lit(1 << k).cast("long")) != 0).otherwise(out)
    return out


def characters(c: F.Column) -> F.Column:
    return F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))


# --- the operator ------------------------------------------------------------------------------------------------


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, by_text: bool = False) -> DataFrame:
    """doc_id, exact and near: numbers of the lines that equal, or nearly equal, a line before them; one row for each
    document that has such lines. With by_text, one row for each doc_id and row (hash of the text)."""
    lines = _hashed(docs, id_col, text_col)
    place = _place(F.col("doc_id"), F.col("line"))
    # equal lines have equal keys: as a part of the group they are folded before the shuffle
    kinds = with_keys(lines, edits).groupBy("h1", "h2", "keys").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    kinds = common.saved(kinds, "lines")

    by_key = Window.partitionBy("key")
    entries = kinds.select(F.explode("keys").alias("key"), "h1")
    met = entries.select("key", "h1", F.min("h1").over(by_key).alias("lo"), F.max("h1").over(by_key).alias("hi")).where("lo <> hi")
    met = common.saved(met.select("key", "h1").distinct(), "met")
    some = common.saved(_fetched(lines, met, place), "candidates")
    late_ones = common.saved(_near(met, some, edits), "late").withColumn("late", F.lit(True))

    flagged = kinds.select("h1", "h2", "first", "n").join(late_ones.hint("merge"), ["h1", "h2"], "left").where("n > 1 OR late")
    flagged = flagged.select("h1", "h2", "first", F.coalesce("late", F.lit(False)).alias("late"))
    whose = ["doc_id", "row"] if by_text else ["doc_id"]
    places = lines.select(*whose, "line", "h1", "h2").join(flagged.hint("merge"), ["h1", "h2"])
    again = place != F.col("first")
    return places.where(again | F.col("late")).groupBy(*whose).agg(
        F.array_sort(F.collect_set(F.when(again, F.col("line")))).alias("exact"),
        F.array_sort(F.collect_set(F.when(~again, F.col("line")))).alias("near"),
    )


def _fetched(lines: DataFrame, met: DataFrame, place: F.Column) -> DataFrame:
    """h1, h2, first, content, n (its words or characters) and counts of the lines that share a key with another."""
    wanted = met.select(F.col("h1").alias("_h")).distinct()
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_LINES else wanted.hint("merge")
    some = lines.join(side, F.col("h1") == F.col("_h"), "left_semi").groupBy("h1", "h2", "content").agg(F.min(place).alias("first"))
    text, half = F.col("content"), len(_LETTERS) // 2
    by_word = _by_word(text)
    counts = [F.when(by_word, _words(text, k, half)).otherwise(_letters(text, _LETTERS[k * half : (k + 1) * half])).alias(f"c{k + 1}") for k in (0, 1)]
    return some.select("h1", "h2", "first", "content", by_word.alias("by_word"), F.size(units(text)).alias("n"), *counts)


def _near(met: DataFrame, some: DataFrame, edits: int) -> DataFrame:
    """h1 and h2 of the lines that are near an earlier one. Both sides of all joins grow with the corpus: they are merged at
    every size, so that small inputs run the plan of large ones."""
    facts = ("first", "h1", "by_word", "n", "c1", "c2")
    sides = met.join(some.select(*facts).hint("merge"), "h1").select("key", *facts)
    side = lambda df, x: df.select(*(F.col(c).alias(f"{c}_{x}") for c in ("key", *facts)))
    half = len(_LETTERS) // 2
    apart = _apart(F.col("c1_a"), F.col("c1_b"), half) + _apart(F.col("c2_a"), F.col("c2_b"), half)
    may = (F.col("by_word_a") == F.col("by_word_b")) & (F.abs(F.col("n_a") - F.col("n_b")) <= edits) & (F.coalesce(apart, F.lit(0)) <= 2 * edits)
    earlier = (F.col("key_a") == F.col("key_b")) & (F.col("first_a") < F.col("first_b"))
    text = lambda x: some.select(F.col("h1").alias(f"_h_{x}"), F.col("first").alias(f"_f_{x}"), F.col("h2").alias(f"h2_{x}"), F.col("content").alias(f"t_{x}")).hint("merge")
    own = lambda x: (F.col(f"h1_{x}") == F.col(f"_h_{x}")) & (F.col(f"first_{x}") == F.col(f"_f_{x}"))

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        return side(a, "a").hint("merge").join(side(b, "b"), earlier & may).select("h1_a", "first_a", "h1_b", "first_b")

    def late(pairs: DataFrame) -> DataFrame:
        """h1, h2 and first of the later lines of the pairs that are near."""
        joined = pairs.distinct().join(text("a"), own("a")).join(text("b"), own("b"))
        a, b = units(F.col("t_a")), units(F.col("t_b"))
        close = joined.where((exchanged(a, b) <= edits) | (edit_distance(a, b, edits) <= edits))
        return close.select(F.col("h1_b").alias("h1"), F.col("h2_b").alias("h2"), F.col("first_b").alias("first")).distinct()

    # a group of near lines is linear in the first round, and few of it are left for the second
    heads = sides.groupBy("key").agg(F.min(F.struct(*facts)).alias("head")).select("key", "head.*")
    soon = common.saved(late(pairs(heads, sides)), "soon")
    known = soon.select(F.col("h1").alias("_h"), F.col("first").alias("_f")).hint("merge")
    rest = sides.join(known, (F.col("h1") == F.col("_h")) & (F.col("first") == F.col("_f")), "left_anti")
    rest = common.saved(rest, "rest")
    # the lines of a key with few left are paired directly: that is linear in its lines
    left = rest.groupBy("key").count().where(F.col("count") > HOT_LINES // 4).select(F.col("key").alias("_k"))
    hot = met.groupBy("key").count().where(F.col("count") > HOT_LINES).join(left.hint("merge"), F.col("key") == F.col("_k")).select("_k")
    hot = common.saved(hot, "hot")
    if hot.isEmpty():
        return soon.unionByName(late(pairs(sides, rest))).select("h1", "h2").distinct()
    shared = F.col("key") == F.col("_k")

    def deep(entries: DataFrame, own: bool) -> DataFrame:
        """The lines of hot keys by their deeper keys."""
        lines = entries.join(hot.hint("merge"), shared, "left_semi").select(*facts).distinct().join(text("x"), (F.col("h1") == F.col("_h_x")) & (F.col("first") == F.col("_f_x")))
        return lines.select(F.explode(F.array_distinct(deep_keys(F.col("t_x"), edits, own))).alias("key"), *facts)

    direct = pairs(sides, rest.join(hot.hint("merge"), shared, "left_anti"))
    return soon.unionByName(late(direct.unionByName(pairs(deep(sides, True), deep(rest, False))))).select("h1", "h2").distinct()


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    gone = removed(docs).withColumnRenamed("doc_id", "_id")
    n_lines = F.size(F.split(common.text_column(docs, "text"), "\n", -1)).cast("long")
    out = docs.select("doc_id", n_lines.alias("n_lines")).join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    some = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    numbers = F.array_join(F.array_sort(F.concat("exact", "near")), ",")
    return out.select("doc_id", "n_lines", some("exact").alias("n_exact"), some("near").alias("n_near"), F.coalesce(numbers, F.lit("")).alias("removed_lines"))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """docs without the removed lines, and without the documents of which no line with content is left."""
    names = docs.columns
    gone = removed(docs, id_col, text_col, edits, by_text=True)
    gone = gone.select(F.col("doc_id").alias("_ld_id"), F.col("row").alias("_ld_row"), F.concat("exact", "near").alias("_ld_gone"))
    text, cut = F.col(text_col).cast("string"), F.col("_ld_gone").isNotNull()
    mine = F.col(id_col).cast("long").eqNullSafe(F.col("_ld_id")) & (F.xxhash64(common.text_column(docs, text_col)) == F.col("_ld_row"))
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("_ld_gone", i))
    out = docs.join(gone, mine, "left").withColumn("_ld_left", F.when(cut, F.array_join(kept, "\n")).otherwise(text))
    out = out.where(~cut | F.col("_ld_left").rlike(r"[^\x20\x09-\x0D]"))
    columns = {text_col: F.col("_ld_left")}
    if text_col == "text" and "n_chars" in names:
        columns["n_chars"] = F.when(cut, F.char_length("_ld_left")).otherwise(F.col("n_chars")).cast("long")
    return out.select(*(columns.get(c, F.col(c)).alias(c) for c in names))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that stand earlier in the corpus, by `cleaned`: null and empty texts stay, documents
    that lose all content go, n_chars follows the text, and the module's other cases hold."""
    return cleaned(docs)
