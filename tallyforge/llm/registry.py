"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import bpe_count, bpe_transducer, conversation_trie, decontaminate, filter_audit, fingerprints, license_scan, line_dedup, ngram_trie, quality, secret_scan, suffix_dedup, warc_zst

Query = Callable[[SparkSession, str], DataFrame]


def _table(name: str, run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


QUERIES: dict[str, Query] = {
    "op1_line_simhash": _table("documents", line_dedup.report),
    "op2_latent_decontamination": lambda spark, sf_dir: decontaminate.leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
    "op3_secret_scan": _table("documents", secret_scan.report),
    "op4_warc_zst": _table("pages", warc_zst.roundtrip),
    "op5_license_tfidf": _table("documents", license_scan.report),
    "op6_bpe_transducer": _table("documents", lambda d: bpe_transducer.roundtrip_digests(d, public_tokenizers.path("word_bpe_49k.json"))),
    "op7_ngram_jaccard": _table("documents", ngram_trie.near_copies),
    "op8_token_counts": _table("documents", lambda d: bpe_count.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json"))),
    "op9_quality_divergence": _table("documents", quality.report),
    "op10_suffix_array": _table("documents", suffix_dedup.report),
    "op11_conversation_trie": _table("conversations", conversation_trie.trie),
    "op12_filter_audit": lambda spark, sf_dir: filter_audit.audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")),
    "op13_lookup_sketch": _table("documents", fingerprints.report),
}

#: Base32 of a SHA-1: five hexadecimal digits make four letters.
_OP4 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
d AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS last, count(*) OVER (PARTITION BY x) AS c,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * CAST(i // 4 AS INT), 5))::BIGINT >> (15 - 5 * CAST(i % 4 AS INT))) & 31)::INT, 1) for i in range(32)], '') AS b32 FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, b32 AS payload_digest,
  CASE WHEN c > 1 AND page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN c > 1 AND page_id IS DISTINCT FROM last THEN last END AS refers_to, true AS valid
FROM d
"""

_SPACE = r"[\x20\x09-\x0D]"
_RULES = quality.Rules()


def _by_language(values: dict[str, list]) -> str:
    return "CASE known " + " ".join(f"WHEN '{lang}' THEN {own}" for lang, own in values.items()) + " END"


_COMMON = _by_language(quality.COMMON)
_WORD_SHARES = _by_language({k: [*own, 1 - sum(own)] for k, own in quality.WORD_SHARES.items()})
_GUESS = ", ".join(f"{{'n': len(list_filter(said, lambda x: list_contains({own}, x))), 'k': {-k}, 'name': '{lang}'}}" for k, (lang, own) in enumerate(quality.COMMON.items()))


def _count(pattern: str) -> str:
    return f"(length(t) - length(regexp_replace(t, '{pattern}', '', 'g')))::DOUBLE"


_CLASSES = ", ".join(map(_count, (_SPACE, r"\p{Nd}", r"\p{Lu}", "[.,]", r"[^\p{L}\p{M}\p{Nd}.,\x20\x09-\x0D]")))
#: Words, windows and histograms written out; the distance is the square root of the mean of both divergences from the mean.
_OP9 = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}\p{{M}}]+'), lambda x: x <> '') AS said FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)), r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
m AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY 1),
v AS (SELECT *, list_max([{_GUESS}]) AS best FROM w),
k AS (SELECT *, CASE WHEN list_contains({[*quality.COMMON]}, lang) THEN lang WHEN best.n >= greatest(1.0, {quality.GUESSED} * len(said)) THEN best.name END AS known FROM v),
c AS (SELECT doc_id, [{_CLASSES}] AS c5, length(t) AS n, said, known, {_COMMON} AS common FROM k),
u AS (SELECT doc_id, known, list_transform(common, lambda x: len(list_filter(said, lambda y: y = x))) AS u20, len(said) AS n_said FROM c),
h AS (SELECT doc_id, n >= {_RULES.min_chars} AS long, list_append(c5, n - list_sum(c5)) AS a, {_by_language(quality.CLASS_SHARES)} AS b, {_RULES.max_class_distance} AS most FROM c
  UNION ALL SELECT doc_id, n_said >= {_RULES.min_judged}, list_append(u20, n_said - list_sum(u20))::DOUBLE[], {_WORD_SHARES}, {_RULES.max_word_distance} FROM u WHERE u20 IS NOT NULL),
p AS (SELECT doc_id, long, most, list_transform(a, lambda x: x / list_sum(a)) AS a, b FROM h WHERE list_sum(a) > 0 AND b IS NOT NULL),
j AS (SELECT doc_id, long, most, sqrt(greatest(0, list_sum(list_transform(range(1, len(a) + 1), lambda i: (CASE WHEN a[i] > 0 THEN a[i] * log2(2 * a[i] / (a[i] + b[i])) ELSE 0 END + CASE WHEN b[i] > 0 THEN b[i] * log2(2 * b[i] / (a[i] + b[i])) ELSE 0 END) / 2)))) AS dist FROM p),
f AS (SELECT doc_id, bool_or(long AND dist > most) AS odd FROM j GROUP BY 1),
x AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda y: length(y))), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(m.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN m USING (doc_id))
SELECT x.*, n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.repeat_percent} * n_words AS base_failed, NOT (n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.repeat_percent} * n_words) AND NOT coalesce(odd, false) AS kept FROM x LEFT JOIN f USING (doc_id)
"""

#: The checksum bit by bit (polynomial 0xEDB88320): a list of the digits, each followed by eight shifts, folded from the left.
_CRC32 = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: list_prepend(CAST(ascii(x) AS BIGINT), [-1::BIGINT for i in range(8)])))), lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END), 4294967295)"
#: Rebuilt conversations as lists, nodes as their prefixes; every ancestor of a node is a prefix of its smallest member.
_OP11 = rf"""
WITH own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT conv_id, s, CAST({_CRC32} % 4 AS BIGINT) AS h FROM own),
b AS (SELECT h.conv_id, list_concat(coalesce(o.s[1:h.h], []), h.s[h.h + 1:]) AS s FROM h LEFT JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, d AS depth, s[1:d] AS s, d = len(s) AS done FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM b)),
n AS (SELECT s, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (done), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
k AS (SELECT s[1:depth - 1] AS s, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
t AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE len(regexp_extract_all(n.s[-1].t, '[^ 	-
]+')) END AS spared FROM n LEFT JOIN k USING (s, depth)),
a AS (SELECT s, depth, sum(leaf) AS n_leaves, sum(spared) AS saved_tokens FROM (SELECT s[1:d] AS s, d AS depth, leaf, spared FROM (SELECT s, unnest(range(depth + 1)) AS d, CAST(n_children = 0 AS INT) AS leaf, spared FROM t)) GROUP BY 1, 2)
SELECT t.conv_id, t.depth, u.conv_id AS parent_conv_id, t.n_convs, t.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, t.ends_sha256
FROM t JOIN a USING (s, depth) LEFT JOIN n u ON u.depth = t.depth - 1 AND u.s = t.s[1:t.depth - 1]
"""

_PICKS = [f"p{k}.x" for k in range(5)]
#: Documents by orders and steps: the step at which each document goes.
_OP12 = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, min(doc_id) OVER (PARTITION BY t) AS least, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS ws FROM d),
f AS (SELECT doc_id, part, CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
  || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
v(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT {" || ".join(_PICKS)} AS filter_order FROM {", ".join(f"v p{k}" for k in range(5))} WHERE len(list_distinct([{", ".join(_PICKS)}])) = 5),
r AS (SELECT part, fails, filter_order, step, substr(filter_order, CAST(step AS INT), 1) AS x, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  coalesce(list_min(list_transform(string_split(nullif(fails, ''), ''), lambda y: instr(filter_order, y))), 6) AS gone
  FROM f LEFT JOIN l USING (doc_id), o, (SELECT unnest(range(1, 6)) AS step)),
s AS (SELECT part, filter_order, CAST(step AS INT) AS step, x, count(*) FILTER (gone > step) AS kept, count(*) FILTER (gone = step) AS removed, count(*) FILTER (gone < step AND contains(fails, x)) AS redundant, count(*) FILTER (fails = x) AS unique_fails,
  count(*) FILTER (gone = step AND good) AS good_lost, count(*) FILTER (gone = step AND toxic) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM s
"""

ORACLE_SQL: dict[str, str] = {"op4_warc_zst": _OP4, "op9_quality_divergence": _OP9, "op11_conversation_trie": _OP11, "op12_filter_audit": _OP12}
