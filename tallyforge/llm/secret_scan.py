"""Secret scans: credential patterns, and tokens that look random and unlike ordinary text for their length.

Patterns give base spans. Besides, every run of ``LEAST`` or more encoding characters is a candidate (with fewer symbols no
token is unlike ordinary text at any useful rate). Its encoding is inferred as the smallest alphabet that has all its
characters, its symbols become numbers below k, and three tests ask whether they are uniform and independent: chi-squared
over the alphabet, Wald-Wolfowitz runs about the middle, and serial correlation at lag 1. Three times the least p-value is
the battery's (valid however the tests depend); a token under ``NOT_RANDOM`` isn't random and is none of the discoveries.

A discovery is a secret, so what is controlled is the rate of ordinary tokens among those reported. The null is a model
of ordinary text by encoding (``ENCODINGS``: how often two symbols are equal, three are, and neighbours differ in kind), and
gives the chi-squared statistic and the number of runs of letters of a case, digits and signs a mean and a
variance that depend on the token's length. Both scores, added and divided by the root of two, make the p-value.
Within each stratum of encoding and length, Benjamini-Hochberg at rate ``fdr`` over the whole corpus says which
candidates are reported, as spans of kind ``random``. p-values are rounded up to a fixed grid, which keeps the control
and makes it a sum over at most a few thousand grid cells, whatever the corpus.

DataFrame expressions only. Texts are read once; compact span rows are staged; thresholds are a handful of numbers.

Defined results: a null text is empty and has no spans; repeated rows are scanned alike; a null id stays null; an empty
table gives no rows; other columns are ignored, whatever their names. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.staging import Workspace, text_of

#: Patterns of the base kinds, in their order, with the fewest characters of the group that counts (fixed values).
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {"assign": (ASSIGN, 2, 12), "access": (r"AKIA[A-Z0-9]+", 0, 18), "hex": (r"[0-9a-f]{16,}", 0, 16)}
#: What a text must match before the pattern is tried; cheaper, and implied by it.
HINTS = {"assign": r"[dDtTnNyY][\"']?\x20*[:=]", "access": "AKIA", "hex": r"[0-9a-f]{16}"}
LEAST = 12  #: characters of a candidate
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}+"
#: Encodings, the smallest alphabet first: pattern, alphabet, and of ordinary text in it the chance that two symbols are equal,
#: that three are, and that neighbours differ in kind. Ordinary hexadecimal strings are decimal numbers, other ones are words.
ENCODINGS = {
    "hex": ("^[0-9a-f]+$", "0123456789abcdef", 0.1, 0.01, 0.1),
    "hexu": ("^[0-9A-F]+$", "0123456789ABCDEF", 0.1, 0.01, 0.1),
    "base32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.06, 0.005, 0.1),
    "base36": ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 0.06, 0.005, 0.1),
    "base36u": ("^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.06, 0.005, 0.1),
    "base64": ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.055, 0.0042, 0.25),
}
NOT_RANDOM = 0.001
STRATA = (LEAST, 16, 20, 32, 48, 80, 160)  #: a candidate's stratum is the last of these that its length reaches
GRID = 20  #: grid cells for each power of ten of p; p-values under 1e-40 share the last


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str, group: int, least: int, hint: str = "") -> Column:
    """Structs (start, end) of leftmost non-overlapping matches whose group has ``least`` characters or more: the
    pieces between the matches and the matches themselves add up to each match's place."""
    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.arrays_zip(lengths(F.slice(F.split(text, pattern, -1), 1, F.size(whole))).alias("gap"), lengths(whole).alias("size"), lengths(part).alias("part"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(s: Column, m: Column) -> Column:
        begin, end = s["at"] + m["gap"], s["at"] + m["gap"] + m["size"]
        out = F.when(m["part"] >= least, F.concat(s["out"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(s["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    found = F.aggregate(rows, start, step, lambda s: s["out"])
    return F.when(text.rlike(hint), found).otherwise(empty) if hint else found


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal: the five-term rational approximation of Abramowitz and Stegun 26.2.17 (fixed values)."""

    def tail(a: Column) -> Column:
        poly = let(1 / (1 + 0.2316419 * a), lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
        return F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly

    return let(z, lambda x: let(tail(F.abs(x)), lambda p: F.when(x >= 0, p).otherwise(1 - p)))


def encoding_of(token: Column) -> Column:
    """(nth, alphabet, k, two, three, change) of the token's encoding."""
    rows = [F.struct(F.lit(nth).alias("nth"), F.lit(alphabet).alias("alphabet"), F.lit(float(len(alphabet))).alias("k"), F.lit(two).alias("two"), F.lit(three).alias("three"), F.lit(change).alias("change")) for nth, (_, alphabet, two, three, change) in enumerate(ENCODINGS.values())]
    out = rows[-1]
    for row, (pattern, *_) in reversed(list(zip(rows[:-1], ENCODINGS.values()))):
        out = F.when(token.rlike(pattern), row).otherwise(out)
    return out


def counted(token: Column, e: Column) -> Column:
    """(n, squares, turns, changes, products): symbols; sum of the squares of the alphabet's counts; neighbours on two sides
    of the alphabet's middle; neighbours of two kinds; sum of products of neighbours, each less the mean."""
    chars = F.filter(F.split(F.translate(token, "-_", "+/"), ""), lambda c: c != "")
    kind = lambda c: F.when(c.between("0", "9"), 0).when(c.between("A", "Z"), 1).when(c.between("a", "z"), 2).otherwise(3)
    number = lambda c: F.struct((F.instr(e["alphabet"], c) - 1).cast("double").alias("x"), kind(c).alias("kind"))
    middle, mean = e["k"] / 2, (e["k"] - 1) / 2
    zero = F.struct(F.lit(None).cast("double").alias("x"), F.lit(None).cast("int").alias("kind"), F.lit(0.0).alias("turns"), F.lit(0.0).alias("changes"), F.lit(0.0).alias("products"))

    def step(s: Column, c: Column) -> Column:
        turns = F.coalesce(((s["x"] >= middle) != (c["x"] >= middle)).cast("double"), F.lit(0.0))
        changes = F.coalesce((s["kind"] != c["kind"]).cast("double"), F.lit(0.0))
        products = F.coalesce((s["x"] - mean) * (c["x"] - mean), F.lit(0.0))
        return F.struct(c["x"].alias("x"), c["kind"].alias("kind"), (s["turns"] + turns).alias("turns"), (s["changes"] + changes).alias("changes"), (s["products"] + products).alias("products"))

    def squares(a: Column) -> Column:
        """A pass over the sorted symbols: a run's length counts up, and each symbol adds twice its place in the run less one."""
        start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
        run = lambda s, c: F.when(s["c"] == c, s["run"] + 1).otherwise(1.0)
        return F.aggregate(F.array_sort(a), start, lambda s, c: F.struct(c.alias("c"), run(s, c).alias("run"), (s["sum"] + 2 * run(s, c) - 1).alias("sum")), lambda s: s["sum"])

    # the symbols as numbers of the alphabet, each seen with the one before
    return let(chars, lambda a: F.struct(F.size(a).cast("double").alias("n"), squares(a).alias("squares"), F.aggregate(F.transform(a, number), zero, step).alias("s")))


def p_values(token: Column) -> Column:
    """(encoding, battery, ordinary): the encoding's number, the p-value of being random, and that of being ordinary text."""

    def tests(e: Column, c: Column) -> Column:
        k, n, turns, changes = e["k"], c["n"], c["s"]["turns"], c["s"]["changes"]
        df = k - 1
        chi = c["squares"] * k / n - n
        z_chi = (F.cbrt(chi / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        z_runs = (turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        z_serial = c["s"]["products"] / ((k * k - 1) / 12) / F.sqrt(n - 1)
        # ordinary text: pairs of equal symbols, which are what chi-squared counts, and changes of kind
        pairs, equal = n * (n - 1) / 2, (c["squares"] - n) / 2
        spread = pairs * e["two"] * (1 - e["two"]) + n * (n - 1) * (n - 2) * (e["three"] - e["two"] * e["two"])
        z_equal = (pairs * e["two"] - equal - 0.5) / F.sqrt(spread)
        z_kinds = (changes - 0.5 - (n - 1) * e["change"]) / F.sqrt(2 * (n - 1) * e["change"] * (1 - e["change"]))
        ps = F.transform(F.array(z_chi, F.abs(z_runs), F.abs(z_serial), (z_equal + z_kinds) / math.sqrt(2)), upper_tail)
        return let(ps, lambda p: F.struct(e["nth"].alias("encoding"), F.least(F.lit(1.0), 3 * F.least(F.get(p, 0), 2 * F.get(p, 1), 2 * F.get(p, 2))).alias("battery"), F.least(F.lit(1.0), F.get(p, 3)).alias("ordinary")))

    return let(encoding_of(token), lambda e: let(counted(token, e), lambda c: tests(e, c)))


def scanned(docs: DataFrame, fdr: float = 0.01, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: base spans by kind, and candidates (start, end, stratum, level on the p-value grid). Places are only
    worked out where a token has a p-value of ``fdr`` or less, as no other one can be a discovery."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    text = F.col("text")

    def tested(token: Column) -> Column:
        length = sum((F.when(F.length(token) >= s, 1).otherwise(0) for s in STRATA), F.lit(-1))
        p = lambda v: F.when(v["battery"] < NOT_RANDOM, 1.0).otherwise(F.greatest(v["ordinary"], F.lit(1e-40)))
        return let(p_values(token), lambda v: F.struct((v["encoding"] * len(STRATA) + length).alias("stratum"), F.floor(-F.log10(p(v)) * GRID).cast("int").alias("level")))

    def placed(v: Column) -> Column:
        cell = lambda start, end, x: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), x["stratum"].alias("stratum"), x["level"].alias("level"))
        low = F.exists(v, lambda x: x["level"] >= math.floor(-math.log10(fdr) * GRID))
        return F.when(low, F.zip_with(v, matches(text, CANDIDATE, 0, LEAST), lambda x, m: cell(m["start"], m["end"], x))).otherwise(F.transform(v, lambda x: cell(F.lit(None), F.lit(None), x)))

    spans = [matches(text, p, g, least, HINTS[kind]).alias(kind) for kind, (p, g, least) in KINDS.items()]
    tokens = F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), tested)
    return rows.select("id", *spans, let(tokens, placed).alias("candidates"))


def thresholds(rows: DataFrame, fdr: float) -> dict[int, int]:
    """By stratum, the lowest grid level that Benjamini-Hochberg rejects. At most one for each stratum reaches the driver."""
    cells = rows.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.level").agg(F.count("*").alias("n"))
    above = Window.partitionBy("stratum").orderBy(F.desc("level"))
    summed = cells.select("stratum", "level", F.sum("n").over(above).alias("least"), F.sum("n").over(Window.partitionBy("stratum")).alias("m"))
    met = summed.filter(F.pow(F.lit(10.0), -F.col("level") / GRID) <= fdr * F.col("least") / F.col("m"))
    return {r["stratum"]: r["level"] for r in met.groupBy("stratum").agg(F.min("level").alias("level")).collect()}


def find_secrets(docs: DataFrame, fdr: float = 0.01, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: its id and ``found``, an array of (start, kind number, kind, end) by start, then kind."""
    with Workspace(docs.sparkSession, "secrets") as work:
        rows = work.keep(work.staged(scanned(docs, fdr, id_column, text_column), "spans"))
    limits = thresholds(rows, fdr)

    def stands(c: Column) -> Column:
        return F.exists(F.array(F.lit(False), *[(c["stratum"] == s) & (c["level"] >= level) for s, level in sorted(limits.items())]), lambda x: x)

    def tagged(k: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    spans = [tagged(k, kind, F.col(kind)) for k, kind in enumerate(KINDS)] + [tagged(len(KINDS), "random", F.filter("candidates", stands))]
    return rows.select(F.col("id").alias(id_column), F.sort_array(F.concat(*spans)).alias("found"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, fdr: float = 0.01) -> DataFrame:
    """Counts by base kind, the hash of the base spans, and all spans as text, for each document."""
    base = F.filter("found", lambda s: s["k"] < len(KINDS))
    count = lambda k, kind: F.size(F.filter("found", lambda s: s["k"] == k)).cast("long").alias(f"n_{kind}")
    counts = [count(k, kind) for k, kind in enumerate(KINDS)]
    return find_secrets(docs, fdr).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
