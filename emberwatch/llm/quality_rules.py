r"""Quality rules with thresholds learned per language and source, in DataFrame and SQL functions only.

Each text gets counts (see ``features``) and from them four measures in whole numbers. Per
(language, source) and measure a quantile sketch is kept: counts in bins of 1/16 relative
width. Sketches merge by adding counts, so those of a language and of all texts come from
the same table; a group with fewer than ``MIN_DOCUMENTS`` texts uses its language's, a
small language's that of all. A text is dropped if a measure lies beyond the fence

    upper: q90 + 3 * (q90 - q50) + slack      lower: q10 - 3 * (q50 - q10) - slack

of its group, or if it fails the base rules. Fences move with what is usual in a group;
the slack keeps groups whose texts are all alike from dropping small deviations.

The texts are read once; features go to the shared folder as narrow rows. The sketch is a
group-by with map-side sums, at most 1,000 bins per group and measure. Thresholds are one
row per group; adaptive execution broadcasts them if their measured size allows.

* Null text has no words and fails the base rules. Very long texts are counted whole.
* Null language or source is a group of its own. Repeated rows count each. Empty table: no
  rows. Other columns are ignored. Ties: a value on a fence is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.sources.store import materialize

MIN_DOCUMENTS = 200
# Measure: slack of its fences, and whether there is a lower one.
MEASURES = {"symbols": (20, False), "repeated_lines": (100, False), "repeated_words": (50, False), "word_length": (100, True)}

_SPACE = r"[\\x20\\x09-\\x0D]"

# lambda variables serve as names here: what they stand for is computed once.
_REPEATED = """
IF(size(w) < 5, 0L,
  element_at(transform(array(transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))), h ->
    IF(size(array_distinct(h)) = size(h), 0L,
      element_at(transform(array(array_sort(transform(h, (x, i) -> struct(x AS x, i AS i)))), s ->
        aggregate(
          array_sort(transform(
            filter(s, (e, k) -> (k > 0 AND s[greatest(k - 1, 0)].x = e.x) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].x = e.x)),
            e -> e.i)),
          struct(0L AS stop, 0L AS n),
          (a, i) -> struct(i + 5L AS stop, a.n + least(5L, i + 5L - a.stop) AS n),
          a -> a.n)), 1))), 1))
"""
_LINES = f"""
element_at(transform(array(filter(split(t, '\\n'), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')), l ->
  struct(size(l) AS n, size(l) - size(array_distinct(l)) AS again)), 1)
"""
_FEATURES = f"""
element_at(transform(array(coalesce({{text}}, '')), t ->
  element_at(transform(array(filter(split(t, '{_SPACE}+'), x -> x <> '')), w ->
    struct(
      CAST(size(w) AS BIGINT) AS n_words,
      CAST(char_length(array_join(w, '')) AS BIGINT) AS word_chars,
      CAST(char_length(t) - char_length(regexp_replace(t, '[#*$%&|<>]', '')) AS BIGINT) AS n_symbols,
      {_LINES} AS lines,
      {_REPEATED} AS n_repeat_words,
      CAST(char_length(t) AS BIGINT) AS n_chars)), 1)), 1)
"""


def features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
             source_column: str = "source") -> DataFrame:
    """Counts of every text, base verdict and measures, with keys for language and source."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    counted = docs.select(
        F.col(id_column).alias("id"), key(lang_column).alias("lang_key"), key(source_column).alias("source_key"),
        F.explode(F.array(F.expr(_FEATURES.format(text=f"`{text_column}`")))).alias("f"),
    )
    return counted.select(
        "id", "lang_key", "source_key", "f.n_words", "f.word_chars", "f.n_symbols", F.col("f.lines.again").cast("bigint").alias("n_dup_lines"),
        "f.n_repeat_words", F.expr("f.n_words < 10 OR 100 * f.n_repeat_words > 20 * f.n_words").alias("base_failed"),
        F.expr("1000 * f.n_symbols div greatest(f.n_chars, 1)").alias("symbols"),
        F.expr("1000 * f.lines.again div greatest(f.lines.n, 1)").alias("repeated_lines"),
        F.expr("1000 * f.n_repeat_words div greatest(f.n_words, 1)").alias("repeated_words"),
        F.expr("100 * f.word_chars div greatest(f.n_words, 1)").alias("word_length"),
    )


def sketch(measured: DataFrame) -> DataFrame:
    """Bin counts (lang_key, source_key, measure, bin, n); tables of parts of the data merge by adding ``n``."""
    pairs = F.expr("stack(4, " + ", ".join(f"'{m}', {m}" for m in MEASURES) + ") AS (measure, v)")
    bins = F.expr("IF(v < 16, v, 16 * (length(bin(v)) - 5) + shiftright(v, length(bin(v)) - 5))")
    return measured.select("lang_key", "source_key", pairs).groupBy("lang_key", "source_key", "measure", bins.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _bin_value(column: str) -> str:
    """Middle of a bin."""
    return (
        f"IF({column} < 32, CAST({column} AS BIGINT), shiftleft(CAST({column} % 16 + 16 AS BIGINT), {column} div 16 - 1) "
        f"+ shiftleft(1L, {column} div 16 - 2))"
    )


def quantiles(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, total, q10, q50, q90) of sketches merged over everything but ``keys``."""
    merged = counts.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "measure")
    run = merged.select(
        *keys, "measure", F.expr(_bin_value("bin")).alias("v"), F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(by).alias("total"),
    )
    at = lambda q: F.min(F.expr(f"IF(100 * upto >= {q} * total, v, NULL)")).alias(f"q{q}")
    return run.groupBy(*keys, "measure").agg(F.first("total").alias("total"), at(10), at(50), at(90))


def thresholds(counts: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """One row per (lang_key, source_key) with the fences of every measure."""
    groups = quantiles(counts, ["lang_key", "source_key"])
    levels = [
        (groups.select("lang_key", "source_key", "measure", *[F.col(c).alias(f"a_{c}") for c in ("total", "q10", "q50", "q90")])),
        (quantiles(counts, ["lang_key"]).select("lang_key", "measure", *[F.col(c).alias(f"b_{c}") for c in ("total", "q10", "q50", "q90")])),
        (quantiles(counts, []).select("measure", *[F.col(c).alias(f"c_{c}") for c in ("q10", "q50", "q90")])),
    ]
    all_ = levels[0].join(levels[1], ["lang_key", "measure"]).join(levels[2], "measure")
    pick = lambda c: F.when(F.col("a_total") >= min_documents, F.col(f"a_{c}")).when(F.col("b_total") >= min_documents, F.col(f"b_{c}")).otherwise(F.col(f"c_{c}"))  # noqa: E731,E501
    picked = all_.select("lang_key", "source_key", "measure", *[pick(c).alias(c) for c in ("q10", "q50", "q90")])
    out = []
    for m, (slack, two_sided) in MEASURES.items():
        of = lambda e, m=m: F.max(F.expr(f"IF(measure = '{m}', {e}, NULL)"))
        out.append(of(f"q90 + 3 * (q90 - q50) + {slack}").alias(f"{m}_max"))
        if two_sided:
            out.append(of(f"q10 - 3 * (q50 - q10) - {slack}").alias(f"{m}_min"))
    return picked.groupBy("lang_key", "source_key").agg(*out)


def quality_rules(docs: DataFrame, id_column: str = "doc_id", min_documents: int = MIN_DOCUMENTS, **columns) -> DataFrame:
    """One row per document: id, counts, ``base_failed`` and ``kept``."""
    measured = materialize(features(docs, id_column, **columns), "features")
    fences = thresholds(materialize(sketch(measured), "sketch"), min_documents)
    inside = [f"{m} <= {m}_max" for m in MEASURES] + [f"{m} >= {m}_min" for m, (_, two) in MEASURES.items() if two]
    return measured.join(fences, ["lang_key", "source_key"]).select(
        F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.expr("NOT base_failed AND " + " AND ".join(inside)).alias("kept"),
    )
