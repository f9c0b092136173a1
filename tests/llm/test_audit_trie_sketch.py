"""Filter audit, conversation trie and lookup sketches against plain Python: nulls, empty and long texts, ties, repeated rows,
empty tables, one very long conversation, and columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import conversation_trie, filter_audit, fingerprints

SPACE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, mask int, part string, digest string, own int, n long"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def documents():
    long = ". ".join(words(k, 30) for k in range(400))
    same = words(1, 130)
    texts = [(1, same, "en"), (2, same, "de"), (3, same, None), (3, same, "en"), (4, None, "en"), (5, "", None), (6, "AB " * 120, "en"), (7, "cost $5 " + words(2, 110), ""), (8, long, "en"), (9, long, "en"), (10, "one line\nand one more. And more! And", "fr"),
             (None, same, "en"), (None, same, "en"), (11, "\n\n \t", "fr"), (12, "é 漢字 🙂. " * 40, "fr"), (12, "é 漢字 🙂. " * 40, "fr"), (13, words(3, 150) + "\n" + words(4, 20), "de"), (-4, words(3, 150), "de")]
    return [(i, t, g, "s", 7, 1, "x", "y", 2, 3) for i, t, g in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS)


def split_words(t):
    return [w for w in re.split(f"[{SPACE}]+", t) if w]


def audit_by_hand(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    fails = []
    for i, t, lang, *_ in rows:
        t = t or ""
        ws = split_words(t)
        f = {"A"} if len(ws) < 100 else set()
        f |= {"B"} if 100 * len(set(ws)) < 80 * len(ws) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        f |= {"D"} if re.search("[#$%&*|]", t) else set()
        f |= {"E"} if i is not None and i > least[t] else set()
        fails.append((i, lang or "", f))
    out = []
    for part in {p for _, p, _ in fails}:
        mine = [(i, f) for i, p, f in fails if p == part]
        removed_of = defaultdict(int)
        lines = []
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                removed_of[x] += len(gone)
                failing = sum(x in f for _, f in mine)
                lines.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(f == {x} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), x))
        out += [(*line[:-1], removed_of[line[-1]]) for line in lines]
    return sorted(out)


def test_audit_against_plain_python(spark, docs):
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, None), (4, None, None), (6, 0, 1), (8, 1, 1), (None, 1, 1), (99, 1, 1), (12, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in filter_audit.audit(docs, table).collect())
    assert got == audit_by_hand(documents(), labels)
    assert len(got) == 600 * 4


def test_audit_without_labels_or_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(docs, none).collect()
    assert len(rows) == 2400 and not any(r.good_lost or r.toxic_lost for r in rows)
    assert filter_audit.audit(docs.filter("doc_id > 1000"), none).count() == 0


def test_audit_of_many_copies_has_few_rows_after_the_first_step(spark):
    copies = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(words(5, 120)).alias("text"), F.lit("en").alias("lang"))
    cells = filter_audit.mask_counts(copies, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert sorted((r["mask"], r["n"]) for r in cells) == [(0, 1), (16, 2999)]


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        said = tuple(own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + own[c][h:])
        for d in range(len(said) + 1):
            members[said[:d]].append(c)
        ends[said].append(c)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids[s]) or 1
        saved[s] = (len(members[s]) - 1) * (len(split_words(s[-1][1])) if s else 0) + sum(saved[k] for k in kids[s])
    digest = lambda s: hashlib.sha256(",".join(map(str, ends.get(s, []))).encode()).hexdigest()
    return sorted((members[s][0], len(s), members[s[:-1]][0] if s else None, len(members[s]), len(kids[s]), leaves[s], saved[s], digest(s)) for s in members)


def talks():
    r = random.Random(4)
    said = ["a b c", "d", "", None, "e  f\n g", "h i"]
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(said[:3]) if t < 3 else r.choice(said)) for c in range(-25, 130) for t in range(r.randint(1, 6))]
    rows += [(c, t, "user", "the very same") for c in range(5000, 5300) for t in range(4)]  # copies, some of which are cut to nothing
    rows += [(20, None, "user", "first"), (20, None, "user", "before it"), (20, 1, "b", "tie"), (20, 1, "a", "tie"), (20, 1, "a", "tie"), (41, None, None, None), (None, 1, "user", "no conversation")]
    return rows


def test_trie_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", 3)
    monkeypatch.setattr(conversation_trie, "CHUNK", 16)
    rows = talks()
    table = spark.createDataFrame([(*x, 1, "k", 2) for x in rows], "conv_id long, turn long, role string, text string, depth int, k1 string, n_convs int").repartition(5)
    assert sorted(tuple(x) for x in conversation_trie.trie(table).collect()) == trie_by_hand(rows)


def test_trie_of_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", 64)
    rows = [(40, t, "user", f"turn {t}") for t in range(700)] + [(41, t, "user", f"turn {t}") for t in range(300)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(tuple(x) for x in conversation_trie.trie(table).collect()) == trie_by_hand(rows)


def test_trie_of_nothing(spark):
    assert conversation_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def pieces(t):
    return {p for p in re.split(r"[\r\n]+|(?<=[.!?])[ \t]+", t) if re.search(f"[^{SPACE}]", p)}


def likeness(a, b):
    a, b = pieces(a), pieces(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def sketches_by_hand(rows):
    rows = sorted(((i is not None, i or 0, t or "") for i, t, *_ in rows))
    out = []
    for k, (known, i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][2]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        out.append((i if known else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(t, edited), 9), round(likeness(t, following), 9)))
    return sorted(out, key=str)


def told(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()), key=str)


def test_sketches_against_plain_python(docs, monkeypatch):
    want = sketches_by_hand(documents())
    assert told(fingerprints.report(docs)) == want
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 2)  # many ranges, each with visitors
    assert told(fingerprints.report(docs)) == want


def test_sketches_of_the_small_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert told(fingerprints.report(table)) == sketches_by_hand([(r.doc_id, r.text) for r in table.collect()])


def test_sketches_over_thousands_of_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 1)
    rows = [(k * 3, f"text {k}. and more of it {k % 7}", None) for k in range(2500)]
    assert told(fingerprints.report(spark.createDataFrame(rows, "doc_id long, text string, lang string"))) == sketches_by_hand(rows)


def test_equal_texts_have_equal_fingerprints(docs):
    rows = docs.join(fingerprints.report(docs).select("doc_id", "fingerprint"), "doc_id").collect()
    prints = defaultdict(set)
    for r in rows:
        prints[r.text or ""].add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values()) and len({x for p in prints.values() for x in p}) == len(prints)


def test_single_and_no_documents(docs):
    one = fingerprints.report(docs.filter("doc_id = 10")).first()
    assert one.near_next == 1.0 and one.n_chars == 36
    assert fingerprints.report(docs.filter("doc_id > 1000")).count() == 0


@pytest.mark.parametrize("differing", [0, 1, 4, 9, 60, 900])
def test_peeling_recovers_all_that_differs(spark, differing):
    base = [k * 7919 for k in range(2000)]
    one, two = base + [-k - 1 for k in range(differing)], base + [10**9 + k for k in range(differing // 2)]
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    row = spark.createDataFrame([(one, two)], "a array<long>, b array<long>").select(hashed("a").alias("a"), hashed("b").alias("b"))
    d = fingerprints.differing(F.col("a"), fingerprints.sketch(F.col("a")), F.col("b"), fingerprints.sketch(F.col("b")))
    got = row.select("a", "b", d.alias("d")).select("d.*", F.array_except("a", "b").alias("x"), F.array_except("b", "a").alias("y")).first()
    assert (got.plus, got.minus) == (differing, differing // 2)
    assert {(f.key, f.sign) for f in got.found} == {(k, 1) for k in got.x} | {(k, -1) for k in got.y}


def test_strings_alone_can_be_compared(spark):
    texts = [("a. b. c. d. e.", "a. b. c. x. e."), ("a. b.", "a. b."), ("", ""), (words(1, 40).replace(" ", ". "), words(2, 40).replace(" ", ". "))]
    of = lambda c: fingerprints.fingerprint(F.col(c), fingerprints.digests(F.col(c)), fingerprints.sketch(fingerprints.digests(F.col(c))))
    rows = spark.createDataFrame(texts, "one string, two string").select(fingerprints.compare(of("one"), of("two")).alias("x")).collect()
    assert [r.x for r in rows] == [pytest.approx(4 / 6), 1.0, 1.0, None]
