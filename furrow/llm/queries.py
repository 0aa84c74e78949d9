"""Queries of the text operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import alignment, bpe, counts, decontaminate, langid, licences, lines, neardup, private, rules, substrings, tries, warc


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.flag(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_records(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url_key", "captured")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_digests(_docs(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(_docs(spark, sf_dir))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_docs(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(_docs(spark, sf_dir), n=4, share=80)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(rules.ledger(_docs(spark, sf_dir)), "strict-1").drop("n_lines")


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_docs(spark, sf_dir)).drop("spans")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings = tries.turn_strings(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return tries.trie(tries.rebuilt(strings)).drop("node", "parent")


def _alignment(spark: SparkSession, sf_dir: str) -> alignment.Alignment:
    return alignment.align(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alignment(spark, sf_dir).scores()


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.find_private(_docs(spark, sf_dir), private.train(private.labelled_table(spark)))


def private_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the search for personal data is exact: the patterns."""
    return op13_private_data(spark, sf_dir).drop("spans")


def redacted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the kinds of their personal data in its place."""
    texts = private.redact(_docs(spark, sf_dir), private.train(private.labelled_table(spark)))
    return texts.select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_sha256"))


def aligned_token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of linked ids: documents that hold it, links, whether it is the commonest of its first id."""
    return _alignment(spark, sf_dir).pairs


def quality_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the strict policy removes, alone and together with the others."""
    return rules.ablate(rules.ledger(_docs(spark, sf_dir)), "strict-1")


def licence_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the licence scan is exact: the phrases."""
    return licences.scan_licences(_docs(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def licence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every notice found with errors: its place by words and its edits."""
    return licences.scan_licences(_docs(spark, sf_dir)).select("doc_id", F.inline("spans"))


def benchmark_cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the benchmark's spans cut out of their texts."""
    cut = decontaminate.clean(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), action="cut")
    return cut.select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_sha256"))


def substring_kept_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the windows that also start earlier."""
    return substrings.deduplicated_texts(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_warc": op2_warc,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_licence_scan": op10_licence_scan,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_alignment": op12_token_alignment,
    "op13_private_data": op13_private_data,
    "aligned_token_pairs": aligned_token_pairs,
    "private_patterns": private_patterns,
    "redacted_texts": redacted_texts,
    "quality_rule_ablation": quality_rule_ablation,
    "licence_phrases": licence_phrases,
    "licence_spans": licence_spans,
    "benchmark_cut_texts": benchmark_cut_texts,
    "substring_kept_texts": substring_kept_texts,
}

ORACLES: dict[str, str] = {
    "op1_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
      FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT p.doc_id, p.n, p.i, g.item FROM p JOIN g ON p.n = g.n AND p.gram = g.gram),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op2_warc": r"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS answer,
             array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 10 * (k // 8), 10) AS BIGINT) >> (35 - 5 * (k % 8))) & 31 AS INTEGER), 1) FOR k IN range(0, 32)], '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = answer THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> answer THEN answer END AS refers_to FROM d""",
    "op3_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM p QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM r),
u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
t AS (SELECT u.doc_id, count(c.k) AS n_removed, string_agg(CASE WHEN c.k IS NULL THEN word END, ' ' ORDER BY u.k) AS kept FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.k = c.k GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)""",
    "op4_line_dedup": r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM s),
k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM u),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped, sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id""",
    "op8_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id, min(r.c) = d.doc_id AS kept FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.n""",
    "op9_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
rw AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d JOIN l USING (doc_id) LEFT JOIN rw USING (doc_id)),
b AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END) + (CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END)
             + (CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words OR word_chars < 2 * n_words THEN 16 ELSE 0 END) AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM b""",
}

_RULES = " UNION ALL ".join(f"SELECT {i} AS i, '{rule}' AS rule" for i, rule in enumerate(rules.RULES))
ORACLES |= {
    "quality_rule_ablation": f"""
WITH q AS ({ORACLES["op9_quality_rules"].strip()}), r AS ({_RULES})
SELECT 'strict-1' AS policy, count(*) AS n_docs, count(*) FILTER (fail_bits = 0) AS n_kept, bit_or(fail_bits) AS any_bits, bit_and(fail_bits) AS all_bits, rule,
       count(*) FILTER ((fail_bits >> i) & 1 = 1) AS n_failing, count(*) FILTER (fail_bits = 1 << i) AS n_failing_alone, count(*) FILTER (fail_bits = 0 OR fail_bits = 1 << i) AS n_kept_without
FROM q, r GROUP BY rule""",
    "licence_phrases": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p(phrase, label, n) AS (VALUES ('gnu general public license', 'gpl', 4), ('apache license', 'apache', 2), ('cc by', 'cc-by', 2), ('mit license', 'mit', 2)),
h AS (SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, w, phrase, label, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, p WHERE len(w) >= n) WHERE array_to_string(w[i:i + n - 1], ' ') = phrase),
t AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN t USING (doc_id)""",
    "substring_kept_texts": ORACLES["op3_substring_dedup"].split("SELECT d.doc_id")[0] + "SELECT d.doc_id, coalesce(kept, '') AS text FROM d LEFT JOIN t USING (doc_id)",
}

#: CRC-32 of the decimal id: the reflected polynomial, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))), lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384 + z))), 4294967295)"
ORACLES["op11_prefix_trie"] = f"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, list(id || ':' || chars ORDER BY turn NULLS FIRST, substr(id, 1, 32)) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM s),
b AS (SELECT h.conv_id, list_concat(coalesce(g.own, [])[1:h], h.own[h + 1:]) AS w FROM h LEFT JOIN s g ON g.conv_id = h.base),
p AS (SELECT conv_id, len(w) AS size, d, array_to_string(w[1:d], '/') || '/' AS node, array_to_string(w[1:d - 1], '/') || '/' AS up, CASE WHEN d = 0 THEN 0 ELSE CAST(string_split(w[d], ':')[2] AS BIGINT) END AS chars FROM b, unnest(range(0, len(w) + 1)) AS u(d)),
n AS (SELECT CASE WHEN d = 0 THEN '' ELSE node END AS node, CASE WHEN d <= 1 THEN '' ELSE up END AS up, d AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(CASE WHEN size = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM p GROUP BY 1, 2, 3),
k AS (SELECT up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.node = k.up),
a AS (SELECT x.node, count(*) FILTER (y.n_children = 0) AS n_leaves, CAST(sum((y.n_convs - 1) * y.chars) AS BIGINT) AS saved_tokens FROM m x JOIN m y ON starts_with(y.node, x.node) GROUP BY x.node)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, a.n_leaves, a.saved_tokens, m.ends_sha256
FROM m JOIN a ON m.node = a.node LEFT JOIN m q ON m.depth > 0 AND q.node = m.up"""

_EMAIL, _IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
_CARD, _PHONE = r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"
_PATTERNS = [("email", _EMAIL, "true"), ("ip", _IP, "list_max(list_transform(string_split(m, '.'), lambda x: coalesce(TRY_CAST(x AS BIGINT), 256))) <= 255"), ("card", _CARD, "length(g) BETWEEN 14 AND 19 AND luhn % 10 = 0"), ("phone", _PHONE, "length(g) BETWEEN 10 AND 15")]
#: Matches and the texts between them give the places.
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, {i} AS rank, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS gap FROM d" for i, (kind, pattern, _) in enumerate(_PATTERNS)
)
_DOUBLED = "list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN (length(g) - i) % 2 = 0 THEN CAST(g[i] AS INTEGER) ELSE (2 * CAST(g[i] AS INTEGER)) // 10 + (2 * CAST(g[i] AS INTEGER)) % 10 END))"
ORACLES["private_patterns"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({_FOUND}),
u AS (SELECT doc_id, kind, rank, m[i] AS m, CAST(list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS place FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f)),
c AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS g FROM u),
l AS (SELECT *, CASE WHEN kind = 'card' AND length(g) <= 19 THEN {_DOUBLED} END AS luhn FROM c),
k AS (SELECT * FROM l WHERE CASE kind {" ".join(f"WHEN '{kind}' THEN {test}" for kind, _, test in _PATTERNS)} END),
t AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, *_ in _PATTERNS)}, string_agg(kind || ':' || place || ':' || (place + length(m)), ',' ORDER BY place, rank) AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in _PATTERNS)}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN t USING (doc_id)"""
