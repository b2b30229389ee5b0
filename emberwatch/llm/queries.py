"""The registered queries of this subpackage: name to (Spark query, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm import (
    alignment,
    bpe_codec,
    collocations,
    exact_dedup,
    jaccard_join,
    language_id,
    license_scan,
    mixing,
    quality_rules,
    repeats,
    sketch_dedup,
    token_counts,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}
VOCABULARY = "word_bpe_49k.json"


def register(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = (fn, oracle)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op9_bpe_codec")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return bpe_codec.token_digests(encoded)


@register("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return counted.selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 2048 AS over_limit")


# -- exact duplicates --------------------------------------------------------------------

OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""


@register("op5_exact_dedup", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


# -- toxicity ----------------------------------------------------------------------------


@register("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = "crc32(CAST(doc_id AS STRING)) % 5 = 0"
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.expr(f"NOT ({held_out})"))
    return scored.selectExpr("doc_id", f"{held_out} AS held_out", "score", "IF(score >= 0.5, 1, 0) AS predicted")


# -- language ----------------------------------------------------------------------------

LANGUAGE_HELD_OUT = "crc32(CAST(doc_id AS STRING)) % 4 = 2"


@register("op3_language_crf")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = language_id.identify(table(spark, sf_dir, "documents"), F.expr(f"NOT ({LANGUAGE_HELD_OUT})"))
    return labelled.selectExpr("doc_id", f"{LANGUAGE_HELD_OUT} AS held_out", "lang_pred", "score", "n_words", "n_switches")


# -- repeated passages -------------------------------------------------------------------


@register("op8_suffix_repeats")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# -- near duplicates ---------------------------------------------------------------------


@register("op1_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, sf_dir, "documents")).drop("text_key")


# -- mixing ------------------------------------------------------------------------------

OP2_SQL = r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), '') AS k, coalesce('=' || source, '-') AS s,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
src AS (SELECT s, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS n_docs FROM rows_ GROUP BY s),
tot AS (SELECT CAST(sum(tokens) AS DOUBLE) AS total FROM src),
p AS (SELECT tokens / total AS p FROM src, tot WHERE tokens > 0),
bisect(i, low, high) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1,
    CASE WHEN ok THEN low ELSE (low + high) / 2 END, CASE WHEN ok THEN (low + high) / 2 ELSE high END
  FROM (SELECT i, low, high,
      (SELECT max(pow(p, (low + high) / 2) / p) / sum(pow(p, (low + high) / 2)) FROM p) <= 1.25 AS ok
    FROM bisect WHERE i < 30)),
a AS (SELECT high AS a FROM bisect WHERE i = 30),
z AS (SELECT sum(pow(p, a)) AS z FROM p, a),
w AS (SELECT s, tokens, n_docs, CAST(ceil(sqrt(n_docs)) AS BIGINT) AS n_blocks,
    CAST(floor(round(pow(tokens / total, a) / z * total, 3)) AS BIGINT) AS share
  FROM src, tot, a, z WHERE tokens > 0),
q AS (SELECT *, share // tokens AS passes, share % tokens AS rest FROM w),
d AS (SELECT r.*, q.passes, q.rest, CAST('0x' || substr(md5(k), 1, 8) AS BIGINT) % n_blocks AS block FROM rows_ r JOIN q USING (s)),
b AS (SELECT s, block, passes, rest, sum(n_tokens) AS size FROM d GROUP BY ALL),
b2 AS (SELECT *, row_number() OVER o AS block_rank, sum(size) OVER (o ROWS UNBOUNDED PRECEDING) AS upto
  FROM b WINDOW o AS (PARTITION BY s ORDER BY md5(s || '/' || block || '/' || passes), block)),
o AS (SELECT s, min(block_rank) AS block_rank FROM b2 WHERE upto > rest AND upto - size <= rest GROUP BY s),
c AS (SELECT d.s, d.k, b2.upto - b2.size + sum(n_tokens) OVER (PARTITION BY d.s ORDER BY md5(k || '/' || d.passes), k) AS upto, d.rest
  FROM d JOIN b2 USING (s, block) JOIN o ON o.s = b2.s AND o.block_rank = b2.block_rank)
SELECT r.doc_id, r.source, r.n_tokens, d.block, CAST(b2.block_rank AS INTEGER) AS block_rank,
  CAST(CASE WHEN d.s IS NULL THEN 0 ELSE d.passes + CASE WHEN b2.upto <= b2.rest OR EXISTS (
    SELECT 1 FROM c WHERE c.s = r.s AND c.k = r.k AND c.upto <= c.rest) THEN 1 ELSE 0 END END AS BIGINT) AS copies
FROM rows_ r LEFT JOIN d ON d.s = r.s AND d.k = r.k LEFT JOIN b2 ON b2.s = d.s AND b2.block = d.block
"""


@register("op2_temperature_mix", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decide(table(spark, sf_dir, "documents"))


# -- quality rules -----------------------------------------------------------------------

OP6_SQL = r"""
WITH t AS (SELECT doc_id, coalesce('=' || lang, '-') AS lang, coalesce('=' || source, '-') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
h AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
f AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, length(t) AS n_chars, len(l) AS n_lines
  FROM w LEFT JOIN r USING (doc_id)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    1000 * n_symbols // greatest(n_chars, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS repeated_lines,
    1000 * n_repeat_words // greatest(n_words, 1) AS repeated_words, 100 * word_chars // greatest(n_words, 1) AS word_length FROM f),
v AS (SELECT lang, source, measure, v FROM (
    SELECT lang, source, unnest(['symbols', 'repeated_lines', 'repeated_words', 'word_length']) AS measure,
      unnest([symbols, repeated_lines, repeated_words, word_length]) AS v FROM m)),
e AS (SELECT *, CASE WHEN v < 32 THEN v ELSE -- middle of the 16 equal parts of a power of two
    (v >> (length(bin(v)) - 5)) * (1 << (length(bin(v)) - 5)) + (1 << (length(bin(v)) - 6)) END AS mid FROM v),
levels AS (SELECT 1 AS level, lang, source, measure, mid FROM e
  UNION ALL SELECT 2, lang, NULL, measure, mid FROM e UNION ALL SELECT 3, NULL, NULL, measure, mid FROM e),
q AS (SELECT level, lang, source, measure, count(*) AS total, quantile_disc(mid, 0.1) AS q10, quantile_disc(mid, 0.5) AS q50, quantile_disc(mid, 0.9) AS q90
  FROM levels GROUP BY ALL),
x AS (SELECT a.lang, a.source, a.measure, unnest(CASE WHEN a.total >= 200 THEN [{'lo': a.q10, 'mi': a.q50, 'hi': a.q90}]
      WHEN b.total >= 200 THEN [{'lo': b.q10, 'mi': b.q50, 'hi': b.q90}] ELSE [{'lo': c.q10, 'mi': c.q50, 'hi': c.q90}] END) AS q
  FROM q a JOIN q b ON b.level = 2 AND b.lang = a.lang AND b.measure = a.measure JOIN q c ON c.level = 3 AND c.measure = a.measure WHERE a.level = 1),
y AS (SELECT lang, source, measure, q.hi + 3 * (q.hi - q.mi) AS top, q.lo - 3 * (q.mi - q.lo) AS low FROM x)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND symbols <= s.top + 20 AND repeated_lines <= l.top + 100 AND repeated_words <= r.top + 50
    AND word_length <= o.top + 100 AND word_length >= o.low - 100 AS kept
FROM m JOIN y s ON s.lang = m.lang AND s.source = m.source AND s.measure = 'symbols'
JOIN y l ON l.lang = m.lang AND l.source = m.source AND l.measure = 'repeated_lines'
JOIN y r ON r.lang = m.lang AND r.source = m.source AND r.measure = 'repeated_words'
JOIN y o ON o.lang = m.lang AND o.source = m.source AND o.measure = 'word_length'
"""


@register("op6_quality_rules", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


# -- licenses ----------------------------------------------------------------------------


@register("op7_license_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


# -- near duplicates by sketches ---------------------------------------------------------


@register("op12_setsketch_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_dedup.similar_documents(table(spark, sf_dir, "documents"))


# -- two tokenizers side by side ---------------------------------------------------------


@register("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
    )


# -- collocations ------------------------------------------------------------------------

OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
s AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM p),
i AS (SELECT lang, unnest(w) AS x, unnest(list_append(w[2 :], NULL)) AS y, unnest(list_concat(w[3 :], [NULL, NULL])[1 : len(w)]) AS z FROM s),
n AS (SELECT lang, count(*) AS n FROM i WHERE x IS NOT NULL GROUP BY lang),
f1 AS (SELECT lang, x, count(*) AS f FROM i WHERE x IS NOT NULL GROUP BY ALL),
f2 AS (SELECT lang, x, y, count(*) AS f FROM i WHERE y IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, x, y, z, count(*) AS f FROM i WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT c.lang, c.x || ' ' || c.y AS phrase, c.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.x = c.x JOIN f1 r ON r.lang = c.lang AND r.x = c.y WHERE c.f >= 10
  UNION ALL SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, 1, l.f, r.f
  FROM f3 c JOIN f1 l ON l.lang = c.lang AND l.x = c.x JOIN f2 r ON r.lang = c.lang AND r.x = c.y AND r.y = c.z
  UNION ALL SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, 2, l.f, r.f
  FROM f3 c JOIN f2 l ON l.lang = c.lang AND l.x = c.x AND l.y = c.y JOIN f1 r ON r.lang = c.lang AND r.x = c.z),
v AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, x || ' ' || y AS phrase, f FROM f3 UNION ALL SELECT lang, y || ' ' || z, f FROM f3) GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN d USING (lang, phrase) WHERE d.f IS NULL OR 100 * d.f < 50 * b.a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


@register("op11_collocations", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
