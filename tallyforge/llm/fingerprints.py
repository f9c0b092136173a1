"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, and what two versions don't share.

A text's paragraphs are its lines, and the sentences of a line; their 64-bit digests are a set. The sketch of a set has
``3 * width`` cells: a digest is added to one cell in each third, and a cell holds a count, the digests XORed, and their
checks XORed. Subtracting the sketches of two texts cell by cell leaves the digests that only one of them has, since the others
cancel; a cell with a count of one and the right check gives one of these away, and taking it out of its other cells frees
more (peeling). If cells are left that none frees, the sketch was too small for the difference: then both sets are dealt by the
bits of the digests into parts of at most ``PART`` and each part is subtracted and peeled by itself, with another salt and
twice the cells after each failure. The likeness of two texts is the Jaccard index of their sets, which the recovered digests give.

The fingerprint is the sketch of ``WIDTH`` in hexadecimal, with the number of digests and a hash of the text before it;
``compare`` works on two such strings alone, as far as their size reaches.

``report`` compares each document to an edited version of it and to the next document. Documents are dealt by ranges of ids,
so that the next one lies in the same range; the first of a range is also sent to the range before. The starts of the
ranges come from a sample of ids and decide how even the ranges are, nothing else.

DataFrame expressions only; one shuffle of the texts.

Defined results: a null text is empty; an empty text has no digests, and two such texts have a likeness of 1; null ids come
first; rows that repeat an id follow one another in the order of their texts; a single row is its own next; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.quality import let
from tallyforge.llm.staging import text_of

WIDTH = 8  #: cells in each third of a fingerprint
PART = 12  #: digests of both texts that are peeled together after a failure; more are dealt into four, ...
SPARE = 1  #: ... once more than an even deal would take; what is larger then is peeled with more cells
TRIES = 8  #: times that a part is retried with twice the cells
ROUNDS = 7  #: of peeling; a difference that needs more counts as a failure
RANGE_ROWS, MOST_RANGES, SAMPLED = 64, 1 << 16, 64  #: documents of a range, if that makes no more than so many ranges; ids sampled for each
PARAGRAPH = r"[\r\n]+|(?<=[.!?])[\x20\t]+"

_ITEM = "struct<key:bigint,sign:int>"


def digests(text: Column) -> Column:
    """The different digests of a text's paragraphs; those of white space alone don't count."""
    return F.array_distinct(F.transform(F.filter(F.split(text, PARAGRAPH), lambda p: p.rlike(r"[^\x20\x09-\x0D]")), lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(7)), 32)


def _placed(items: Column, width: Column, salt: Column) -> Column:
    """Items with their check and their place in each third."""

    def item(x: Column) -> Column:
        place = lambda h, k: F.shiftrightunsigned(h, 21 * k).bitwiseAND(F.lit((1 << 21) - 1)).cast("int") % width
        return let(F.xxhash64(x["key"], salt), lambda h: F.struct(x["key"].alias("key"), x["sign"].alias("sign"), _check(x["key"]).alias("check"), *[place(h, k).alias(f"place{k}") for k in range(3)]))

    return F.transform(items, item)


def _cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.alias("n"), key.alias("key"), check.alias("check"))


def _added(cell: Column, at: Column, third: int, placed: Column, times: int) -> Column:
    """``cell`` number ``at`` of a ``third`` with the items that lie in it added (``times`` 1) or taken out (-1)."""
    put = lambda s, x: _cell(s["n"] + x["sign"] * times, s["key"].bitwiseXOR(x["key"]), s["check"].bitwiseXOR(x["check"]))
    return F.aggregate(F.filter(placed, lambda x: x[f"place{third}"] == at), cell, put)


def cells(items: Column, width: Column, salt: Column) -> Column:
    """The sketch of items (key, sign): of one set with signs of 1, or of a difference with those of the second at -1."""
    none = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))
    third = lambda p, k: F.transform(F.sequence(F.lit(0), width - 1), lambda at: _added(none, at, k, p, 1))
    return let(_placed(items, width, salt), lambda p: F.concat(*[third(p, k) for k in range(3)]))


def subtract(one: Column, two: Column) -> Column:
    return F.zip_with(one, two, lambda a, b: _cell(a["n"] - b["n"], a["key"].bitwiseXOR(b["key"]), a["check"].bitwiseXOR(b["check"])))


def peel(difference: Column, width: Column, salt: Column) -> Column:
    """(done, plus, minus, found): whether all cells could be emptied, how many digests the first and the second set have alone, and these."""

    def freed(state: Column) -> Column:
        alone = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["check"] == _check(c["key"])))
        return F.array_distinct(F.transform(alone, lambda c: F.struct(c["key"].alias("key"), c["n"].alias("sign"))))

    item_list = F.array().cast(f"array<{_ITEM}>")
    state_of = lambda cells_, found, over, done: F.struct(cells_.alias("cells"), found.alias("found"), over.alias("over"), done.alias("done"))

    def taken(state: Column, items: Column) -> Column:
        third = lambda p, k: F.transform(F.slice(state["cells"], width * k + 1, width), lambda c, at: _added(c, at, k, p, -1))
        without = let(_placed(items, width, salt), lambda p: F.concat(*[third(p, k) for k in range(3)]))
        return state_of(without, F.concat(state["found"], items), F.lit(False), F.lit(False))

    left = lambda state: F.exists(state["cells"], lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0))
    stopped = lambda state: state_of(F.slice(state["cells"], 1, 0), state["found"], F.lit(True), ~left(state))
    step = lambda state, _: F.when(state["over"], state).otherwise(let(freed(state), lambda items: F.when(F.size(items) == 0, stopped(state)).otherwise(taken(state, items))))
    count = lambda state, sign: F.size(F.filter(state["found"], lambda x: x["sign"] == sign))
    told = lambda state: F.struct(state["done"].alias("done"), count(state, 1).alias("plus"), count(state, -1).alias("minus"), state["found"].alias("found"))
    return let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state_of(difference, item_list, F.lit(False), F.lit(False)), step), told)


def signed(one: Column, two: Column) -> Column:
    """Both sets' digests as items, those of ``two`` with a sign of -1."""
    item = lambda sign: lambda d: F.struct(d.alias("key"), F.lit(sign).alias("sign"))
    return F.concat(F.transform(one, item(1)), F.transform(two, item(-1)))


def parts(items: Column) -> Column:
    """Items dealt by two bits of their digests at a time, until at most ``PART`` are together; linear in their number."""

    def deeper(groups: Column, level: Column) -> Column:
        bits = lambda x: F.call_function("shiftrightunsigned", x["key"], 2 * level).bitwiseAND(F.lit(3))
        four = lambda g: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.filter(g, lambda x: bits(x) == b))
        dealt = F.transform(groups, lambda g: F.when(F.size(g) > PART, four(g)).otherwise(F.array(g)))
        return F.when(F.exists(groups, lambda g: F.size(g) > PART), F.flatten(dealt)).otherwise(groups)

    wanted = F.greatest(F.lit(0), F.ceil(F.log2(F.size(items) / PART) / 2)).cast("int") + SPARE
    return let(F.array(items), lambda all_: F.when(F.size(items) <= PART, all_).otherwise(F.aggregate(F.sequence(F.lit(0), wanted), all_, deeper)))


def retried(part: Column) -> Column:
    """(done, plus, minus, found) of a part, with twice the cells and another salt after each failure. What would fail to the
    last, about as likely as two equal digests of different paragraphs, is null."""

    def attempt(t: Column) -> Column:
        width = F.call_function("shiftleft", F.greatest(F.lit(4), F.least(F.lit(WIDTH), F.size(part))), t)
        return peel(cells(part, width, t), width, t)

    none = F.struct(F.lit(False).alias("done"), F.lit(None).cast("int").alias("plus"), F.lit(None).cast("int").alias("minus"), F.array().cast(f"array<{_ITEM}>").alias("found"))
    more = lambda: F.aggregate(F.sequence(F.lit(1), F.lit(TRIES - 1)), none, lambda s, t: F.when(s["done"], s).otherwise(attempt(t)))
    known = lambda s: F.when(s["done"], s).otherwise(none)
    return let(attempt(F.lit(0)), lambda s: F.when(s["done"], s).otherwise(let(more(), known)))


def sketch(found: Column) -> Column:
    """The fingerprint's cells of a set of digests."""
    return cells(F.transform(found, lambda d: F.struct(d.alias("key"), F.lit(1).alias("sign"))), F.lit(WIDTH), F.lit(0))


def differing(one: Column, cells_one: Column, two: Column, cells_two: Column) -> Column:
    """(plus, minus, found): the digests of either set alone, from the fingerprints' difference or, if that fails, part by part."""
    total = lambda p, field: F.aggregate(p, F.lit(0), lambda s, x: s + x[field])
    larger = lambda: let(F.transform(parts(signed(one, two)), retried), lambda p: F.struct(total(p, "plus").alias("plus"), total(p, "minus").alias("minus"), F.flatten(F.transform(p, lambda x: x["found"])).alias("found")))
    return let(peel(subtract(cells_one, cells_two), F.lit(WIDTH), F.lit(0)), lambda r: F.when(r["done"], F.struct(r["plus"].alias("plus"), r["minus"].alias("minus"), r["found"].alias("found"))).otherwise(larger()))


def likeness(n: Column, plus: Column, minus: Column) -> Column:
    """Jaccard index, of a set of ``n`` digests of which ``plus`` are its own and the other set has ``minus`` more; 1 of two empty sets."""
    return F.when(n + minus == 0, F.lit(1.0)).otherwise((n - plus) / (n + minus))


def fingerprint(text: Column, found: Column, made: Column) -> Column:
    """Hexadecimal text of a sketch: hash of the text, number of digests, cells."""
    cell = lambda c: F.concat_ws(".", c["n"], F.hex(c["key"]), F.hex(c["check"]))
    return F.lower(F.concat_ws("-", F.hex(F.xxhash64(text)), F.size(found), F.array_join(F.transform(made, cell), "-")))


def compare(one: Column, two: Column) -> Column:
    """Likeness of two fingerprints from their strings alone; null where they differ in more than their cells can tell."""

    def read(print_: Column) -> Column:
        long = lambda h: F.conv(h, 16, -10).cast("long")
        fields = F.transform(F.slice(F.split(print_, "-"), 3, 3 * WIDTH), lambda c: F.split(c, r"\."))
        return F.transform(fields, lambda c: _cell(F.get(c, 0).cast("int"), long(F.get(c, 1)), long(F.get(c, 2))))

    n = F.get(F.split(one, "-"), 1).cast("int")
    return let(peel(subtract(read(one), read(two)), F.lit(WIDTH), F.lit(0)), lambda r: F.when(r["done"], likeness(n, r["plus"], r["minus"])))


def in_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, text, part, visits): each row in its range of ids, and once more, visiting, in the range before if it begins one.
    The first of all visits the last range."""
    ids = docs.select("doc_id")
    n, low, unnamed = ids.agg(F.count("*"), F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    starts: list[int] = []
    if ranges > 1:
        asked = F.from_json(F.lit(str([k / ranges for k in range(1, ranges)])), "array<double>")
        cut = ids.sample(min(1.0, SAMPLED * ranges / n), 1).agg(F.array_sort(F.array_distinct(F.percentile_approx("doc_id", asked, F.lit(max(10_000, 4 * ranges)))))).first()[0]
        starts = cut or []
    step = max(1, int(len(starts) ** 0.5))
    rows = [starts[k : k + step] for k in range(0, len(starts), step)]
    literal = lambda xs: F.array(*[F.lit(x) for x in xs])
    at, wanted = F.lit(0), F.col("doc_id")
    if rows:  # the row of starts first, then the place in it
        table = F.from_json(F.lit(str(rows)), "array<array<bigint>>")
        row = F.size(F.filter(literal(r[0] for r in rows), lambda s: s <= wanted))
        at = F.when(row == 0, 0).otherwise((row - 1) * step + F.size(F.filter(F.get(table, row - 1), lambda s: s <= wanted)))
        at = F.when(wanted.isNull(), 0).otherwise(at)
    begins = F.size(F.filter(F.get(F.from_json(F.lit(str(rows)), "array<array<bigint>>"), ((F.col("part") - 1) / step).cast("int")), lambda s: s == wanted)) > 0 if rows else F.lit(False)
    first = wanted.isNull() if unnamed else wanted.eqNullSafe(F.lit(low))
    last = len(starts)
    dealt = docs.select("doc_id", "text", at.cast("int").alias("part"))
    place = lambda part, visits: F.struct(part.alias("part"), F.lit(visits).alias("visits"))
    places = F.concat(
        F.array(place(F.col("part"), 0)),
        F.when((F.col("part") > 0) & begins, F.array(place(F.col("part") - 1, 1))).otherwise(F.array().cast("array<struct<part:int,visits:int>>")),
        F.when(first, F.array(place(F.lit(last), 2))).otherwise(F.array().cast("array<struct<part:int,visits:int>>")),
    )
    return dealt.select("doc_id", "text", F.inline(places))


def report(docs: DataFrame) -> DataFrame:
    """For each document: its length, the hash of the edited text, both fingerprints, and the likeness of the first to the second and to
    the next document's. The edited text has its last quarter replaced by the beginning of the next document."""
    rows = in_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))).withColumn("own", digests(F.col("text")))
    order = Window.partitionBy("part").orderBy("visits", F.col("doc_id").asc_nulls_first(), "text")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    paired = rows.select("doc_id", "text", "own", "visits", F.lead("text").over(order).alias("next_text"), F.lead("own").over(order).alias("next")).filter("visits = 0")
    edited = paired.select("doc_id", "text", "own", "next", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter)).alias("edited"))
    found = edited.withColumn("new", digests(F.col("edited")))
    made = found.withColumns({"cells": sketch(F.col("own")), "new_cells": sketch(F.col("new")), "next_cells": sketch(F.col("next"))})
    apart = made.select(
        "*", differing(F.col("own"), F.col("cells"), F.col("new"), F.col("new_cells")).alias("to_new"), differing(F.col("own"), F.col("cells"), F.col("next"), F.col("next_cells")).alias("to_next")
    )
    near = lambda c: likeness(F.size("own"), F.col(c)["plus"], F.col(c)["minus"])
    return apart.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("text"), F.col("own"), F.col("cells")).alias("fingerprint"), fingerprint(F.col("edited"), F.col("new"), F.col("new_cells")).alias("edited_fingerprint"),
        near("to_new").alias("near_edited"), near("to_next").alias("near_next"),
    )
