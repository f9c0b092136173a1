"""The native operators' methods against plain Python, and the pipeline's stages on awkward tables."""

import hashlib
import math
import os
import random
from collections import Counter

import duckdb
import regex
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyforge.llm import bpe_transducer, license_scan, quality, registry, secret_scan
from tests.llm.test_operators import KIND, texts, words
from tests.test_oracle import rows


def upper_tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def plain_p_values(token):
    for name, (pattern, alphabet, two, three, change) in secret_scan.ENCODINGS.items():
        if set(token.replace("-", "+").replace("_", "/")) <= set(alphabet) and (pattern == "" or all(c in alphabet for c in token)):
            break
    x = [alphabet.index(c) for c in token.replace("-", "+").replace("_", "/")]
    n, k = len(x), len(alphabet)
    counts = Counter(x)
    chi, df = sum((c - n / k) ** 2 / (n / k) for c in counts.values()) + (k - len(counts)) * n / k, k - 1
    z_chi = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    turns = sum((a >= k / 2) != (b >= k / 2) for a, b in zip(x, x[1:]))
    z_runs = (turns - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    z_serial = sum((a - (k - 1) / 2) * (b - (k - 1) / 2) for a, b in zip(x, x[1:])) / ((k * k - 1) / 12) / math.sqrt(n - 1)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in token]
    equal = sum(c * (c - 1) / 2 for c in counts.values())
    mean, var = n * (n - 1) / 2 * two, n * (n - 1) / 2 * two * (1 - two) + n * (n - 1) * (n - 2) * (three - two * two)
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    z = ((mean - equal - 0.5) / math.sqrt(var) + (changes - 0.5 - (n - 1) * change) / math.sqrt(2 * (n - 1) * change * (1 - change))) / math.sqrt(2)
    return name, min(1.0, 3 * min(upper_tail(z_chi), 2 * upper_tail(abs(z_runs)), 2 * upper_tail(abs(z_serial)))), min(1.0, upper_tail(z))


def tokens():
    r = random.Random(4)
    some = ["".join(r.choice(a) for _ in range(n)) for a in ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCabc012+/-_xyzXYZ") for n in (12, 20, 33, 70)]
    return some + ["internationalization", "path/to/some-long_file", "aaaaaaaaaaaaaaaaaaaaaaaa", "123456789012345678901234", "x" * 300]


def test_battery_against_python(spark):
    rows = spark.createDataFrame([(t,) for t in tokens()], "t string").select("t", secret_scan.p_values(F.col("t")).alias("p")).collect()
    for r in rows:
        name, battery, ordinary = plain_p_values(r.t)
        assert list(secret_scan.ENCODINGS)[r.p.encoding] == name
        assert r.p.battery == pytest.approx(battery, abs=2e-6) and r.p.ordinary == pytest.approx(ordinary, abs=2e-6)


def test_thresholds_are_benjamini_hochberg(spark):
    r = random.Random(5)
    levels = [(s, int(r.expovariate(0.05)) if r.random() < 0.8 else r.randint(60, 300)) for s in (1, 2) for _ in range(300)]
    rows = spark.createDataFrame([([{"start": 0, "end": 1, "stratum": s, "level": level}],) for s, level in levels], "candidates array<struct<start: int, end: int, stratum: int, level: int>>")
    got = secret_scan.thresholds(rows, 0.01)
    for s in (1, 2):
        ps = sorted(10 ** (-level / secret_scan.GRID) for t, level in levels if t == s)
        last = max((p for k, p in enumerate(ps, 1) if p <= 0.01 * k / len(ps)), default=None)
        assert last is not None and 10 ** (-got[s] / secret_scan.GRID) == pytest.approx(last)


def test_secrets_beyond_the_patterns(spark):
    r = random.Random(6)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(k, "key " + "".join(r.choice(alphabet) for _ in range(40)) + " end") for k in range(40)] + [(100 + k, " ".join(["".join(r.choice(["the", "an", "ing", "tion", "er", "Re"]) for _ in range(9)) for _ in range(20)])) for k in range(40)]
    found = {x.doc_id: x.spans for x in secret_scan.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("random" in found[k] for k in range(40)) >= 36 and not any("random" in found[100 + k] for k in range(40))


def js(a, b):
    total = sum(a)
    out = 0.0
    for x, y in zip([v / total for v in a], b):
        m = (x + y) / 2
        out += (x * math.log2(x / m) if x else 0) / 2 + (y * math.log2(y / m) if y else 0) / 2
    return math.sqrt(max(0.0, out))


def known_language(lang, said):
    if lang in quality.COMMON:
        return lang
    uses = [(sum(w in own for w in said), -k, name) for k, (name, own) in enumerate(quality.COMMON.items())]
    best = max(uses)
    return best[2] if best[0] >= max(1, quality.GUESSED * len(said)) else None


def odd(text, lang, rules=quality.Rules()):
    """Whether the histograms of a text are too far from its language's, written out."""
    import re
    import unicodedata

    text = text or ""
    classes = [0] * 6
    for c in text:
        kind = unicodedata.category(c)
        classes[0 if c in " \t\n\r\v\f" else 1 if kind == "Nd" else 2 if kind == "Lu" else 3 if c in ".," else 4 if kind[0] not in "LM" else 5] += 1
    said = [w for w in regex.split(r"[^\p{L}\p{M}]+", text.lower()) if w]
    lang = known_language(lang, said)
    if lang is None:
        return False
    far = len(text) >= rules.min_chars and js(classes, quality.CLASS_SHARES[lang]) > rules.max_class_distance
    uses = Counter(said)
    each = [uses[w] for w in quality.COMMON[lang]]
    shares = quality.WORD_SHARES[lang]
    return far or len(said) >= rules.min_judged and js([*each, len(said) - sum(each)], [*shares, 1 - sum(shares)]) > rules.max_word_distance


def test_quality_verdicts_against_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.union(docs.withColumn("doc_id", F.col("doc_id") + 10**6).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx")))
    got = {r.doc_id: r for r in quality.judge(docs).select("doc_id", "text", "lang", *[F.col(quality.P + c).alias(c) for c in ("base_failed", "kept")]).collect()}
    assert 0 < sum(not r.kept for r in got.values()) < len(got)
    assert [r.doc_id for r in got.values() if r.kept != (not r.base_failed and not odd(r.text, r.lang))] == []


#: Invented sentences of four scripts, and lines of code: each is repeated with other words, so that the repetition rule passes.
SCRIPTS = {
    "hindi": "यह एक लंबा लेख है जिसमें बहुत से शब्द हैं और हर वाक्य अलग बात कहता है".split(),
    "russian": "это длинный текст в котором много слов и каждое предложение говорит о другом".split(),
    "greek": "αυτό είναι ένα μεγάλο κείμενο με πολλές λέξεις και κάθε πρόταση λέει κάτι άλλο".split(),
    "thai": "นี่ คือ ข้อความ ยาว ที่ มี คำ มากมาย และ ทุก ประโยค กล่าว ถึง สิ่ง อื่น".split(),
    "arabic": "هذا نص طويل فيه كلمات كثيرة وكل جملة تقول شيئا آخر عن العالم".split(),
    "code": "for i in range(n): if x[i] != y[i]: return f(x, y) else: total += w[i] * 2;".split(),
}


@pytest.mark.parametrize("lang", [None, "xx"])
def test_other_scripts_and_code_are_not_judged_by_european_histograms(spark, lang):
    r = random.Random(3)
    rows = [(k, " ".join(r.choice(ws) + r.choice(ws) for _ in range(160)), lang) for k, ws in enumerate(SCRIPTS.values())]
    rows.append((99, " ".join(r.choice("lorem ipsum dolor sit amet".split()) + str(k) for k in range(160)), "en"))
    got = {x.doc_id: x.kept for x in quality.report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {**{k: True for k in range(len(SCRIPTS))}, 99: False}


HEADERS = {
    "GPL-2.0-or-later": "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.\n\ncode()",
    "GPL-3.0-or-later": " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */\nint main;",
    "LGPL-2.1-or-later": "// This library is free software; you can redistribute it and/or\n// modify it under the terms of the GNU Lesser General Public\n// License as published by the Free Software Foundation; either\n// version 2.1 of the License, or (at your option) any later version.",
    "Apache-2.0": "x = 1\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n",
    "MIT": "Some tool\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
    "ISC": "/* SPDX-License-Identifier: ISC */\nreturn 1;",
}


def test_license_headers_and_files(spark):
    bsd2, bsd3 = (f"Copyright (c) 2020, A Name\nAll rights reserved.\n\n{t.replace('. 2', chr(10) + '2')}\n\n{license_scan._DISCLAIMER}" for t in (license_scan._BSD2, license_scan._BSD2 + "\n" + license_scan._THIRD))
    rows = [(f"/{k}/a.c", text, name) for k, (name, text) in enumerate(HEADERS.items())] + [("/b2/LICENSE", bsd2, "BSD-2-Clause"), ("/b3/COPYING", bsd3, "BSD-3-Clause"), ("/g/LICENSE", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.", "GPL-3.0"), ("/p/t.txt", "This text speaks of a license now and then, and of software, as texts do.", None)]
    files = spark.createDataFrame([(k, p, t) for k, (p, t, _) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r.doc_id: r.own_license for r in license_scan.scan(files, F.col("path")).collect()}
    assert [got[k] for k in range(len(rows))] == [name for *_, name in rows]


def test_license_cosines_against_python(spark):
    r = random.Random(8)
    units = [" ".join(w for w in text.split() if r.random() > 0.2) for _, text in license_scan.TEMPLATES] + ["nothing of the kind", ""]
    df, n = {"license": 40, "the": 90, "of": 80, "under": 30, "version": 10}, 100
    table = spark.createDataFrame([(u,) for u in set(units)], "unit string").withColumn("key", license_scan.unit_key())
    got = {x.unit: (x.license, x.cosine) for x in license_scan.match_units(table, df, n).join(table, "key").collect()}
    known = license_scan.template_weights(df, n)
    for u in units:
        x = {t: c * license_scan.rarity(df.get(t, 0), n) for t, c in license_scan.term_counts(u).items()}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
        cosines = [round(sum(x.get(t, 0) * v for t, v in w.items()) / norm / math.sqrt(sum(v * v for v in w.values())), 9) for w in known]
        best = max(cosines)
        if best < license_scan.COSINE:
            assert u not in got
        else:
            assert got[u][1] == pytest.approx(best, abs=1e-8) and got[u][0] == license_scan.TEMPLATES[cosines.index(best)][0]
        if best >= license_scan.COSINE:
            assert set(license_scan.term_counts(u)) & set(license_scan.marks(known, df))  # what is left out can't be near


def test_few_lines_of_ordinary_text_make_units(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.coalesce("text", F.lit("")).alias("text"))
    df, n = license_scan.document_counts(texts)
    mark = license_scan.marks(license_scan.template_weights(df, n), df)
    units = texts.select(F.length("text").alias("chars"), license_scan.unit_texts(F.col("text"), F.lit("/a/b"), mark).alias("u"))
    total = units.agg(F.sum("chars").alias("chars"), F.sum(F.aggregate("u", F.lit(0), lambda s, x: s + F.length(x))).alias("of_units")).first()
    assert 0 < total.of_units < 0.5 * total.chars


def test_units_hold_every_near_window(spark):
    """A notice of any wrapping, with text around it, has a unit as near to its template as the notice itself."""
    r = random.Random(5)
    filler = lambda k: [" ".join(r.choice("lorem ipsum dolor sit amet consectetur elit".split()) for _ in range(9)) for _ in range(k)]
    df, n = {"the": 90, "of": 80, "and": 85, "to": 80, "use": 60, "work": 50}, 100
    mark = license_scan.marks(license_scan.template_weights(df, n), df)
    rows = []
    for k, (name, text) in enumerate(license_scan.TEMPLATES):
        ws, width = text.split(), r.randint(7, 12)
        lines = [" ".join(ws[i : i + width]) for i in range(0, len(ws), width)]
        rows.append((k, name, "\r\n".join([*filler(3), "", *["// " + x for x in lines], "", *filler(4)])))
    table = spark.createDataFrame(rows, "k int, name string, text string")
    units = table.select("k", "name", F.explode(license_scan.unit_texts(F.col("text"), F.lit("/x/a.c"), mark)).alias("unit")).withColumn("key", license_scan.unit_key())
    best = license_scan.match_units(units.select("key", "unit").distinct(), df, n)
    found = {(x.k, x.license) for x in units.join(best, "key").select("k", "license").collect()}
    assert [k for k, name, _ in rows if (k, name) not in found] == []


def test_unmarked_and_very_long_files(spark):
    long = "\n".join(["int x = 1; // nothing here"] * 40000) + "\nLicensed under the Apache License, Version 2.0.\n" + "y = 2\n" * 40000
    files = spark.createDataFrame([(1, "/a/f.c", long), (2, "/a/g.c", "words of no kind"), (3, "/a/h.c", "\n\n"), (4, None, "Released under the MIT License.")], "doc_id long, path string, text string")
    got = {x.doc_id: (x.own_license, x.license) for x in license_scan.scan(files, F.col("path")).collect()}
    assert got == {1: ("Apache-2.0", "Apache-2.0"), 2: (None, "Apache-2.0"), 3: (None, "Apache-2.0"), 4: ("MIT", "MIT")}


def awkward(spark):
    """Documents with nulls, copies, odd columns and long texts."""
    r = random.Random(6)
    common = [w for name in ("en",) for w, share in zip(quality.COMMON[name], quality.WORD_SHARES[name]) for _ in range(round(1000 * share))]
    prose = [(100 + k, ". ".join(" ".join(r.choice(common) if r.random() < 0.27 else words(900 + k * 1000 + j * 20 + i, 1) for i in range(12)).capitalize() for j in range(14)) + ".") for k in range(3)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "z", 7, "k", "dd") for i, t in [*texts(), *prose]], KIND).withColumn("a`b", F.lit(1))


def test_roundtrip_of_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    docs = awkward(spark)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_transducer.roundtrip_digests(docs, path).collect()]
    assert sorted(got) == sorted(want)
    assert bpe_transducer.roundtrip_digests(docs.filter("doc_id < -1"), path).count() == 0


def test_roundtrip_of_every_awkward_row(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    docs = awkward(spark)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_transducer.roundtrip_digests(docs, path).collect()]
    assert len(want) == len(texts()) + 3 and sorted(got) == sorted(want)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_tables(spark, sf_dir, stage):
    docs = awkward(spark)
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, sf_dir)
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    if stage == "quality rules":
        base = {(r.doc_id, r.n_chars) for r in quality.judge(docs).filter(f"{quality.P}base_failed").collect()}
        want = sorted((r.doc_id, r.n_chars) for r in docs.collect() if (r.doc_id, r.n_chars) not in base and not odd(r.text, r.lang))
        assert sorted((r.doc_id, r.n_chars) for r in out.collect()) == want and {100, 101, 102} <= {i for i, _ in want}
    elif stage == "n-gram Jaccard join":
        assert out.filter("doc_id IN (1, 2, 3)").count() == 1 and out.filter("doc_id IN (7, 8)").count() == 1 and out.filter("doc_id IS NULL").count() == docs.filter("doc_id IS NULL").count()
        assert out.filter("doc_id NOT IN (1, 2, 3, 7, 8)").count() == docs.filter("doc_id NOT IN (1, 2, 3, 7, 8)").count()
    elif stage != "line dedup":
        assert out.count() == docs.count()
    assert 0 < out.count() <= docs.count()
    assert run(spark, docs.filter("doc_id < -1"), sf_dir).count() == 0


def test_line_stage_drops_lines_with_an_edit_in_every_word(spark, sf_dir):
    line = "abcdefgh bcdefghi cdefghij defghijk efghijkl fghijklm"
    rows = [(1, line, len(line)), (2, " ".join(w[:3] + "z" + w[4:] for w in line.split()) + "\nanother thing", 0)]
    out = corpus_pipeline.line_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), sf_dir).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, line), (2, "another thing")]


def test_pipeline_is_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {"": docs.count()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        kept[name] = docs.count()
    want = {r.doc_id: r.text for r in docs.collect()}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    assert {r.doc_id for r in got} == set(want) and len(got) == len(want) and list(kept.values()) == sorted(kept.values(), reverse=True)
    assert all(r.token_ids == library.encode(want[r.doc_id] or "", add_special_tokens=False).ids for r in got)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for f in os.listdir(sf_dir):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    ours, theirs = rows(registry.QUERIES[name](spark, sf_dir).toPandas()), rows(duck.execute(registry.ORACLE_SQL[name]).fetchdf())
    assert ours == theirs and ours[1]
