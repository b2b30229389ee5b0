"""Mixing sources to target weights by temperature.

Token shares p of the sources become weights p**a / sum(p**a). The exponent a between 0
(all sources alike) and 1 (as they are) is bisected: it is the least one that keeps the
entropy of the weights at or below a target, or the times that any source's tokens are
repeated at or below a limit. A budget of tokens is then dealt out by weight.

A source of n documents is cut into ceil(sqrt(n)) blocks by a hash of the id. It is passed
as many whole times as its budget holds; what is left is filled from a permutation of its
blocks, seeded by source and pass, and the last block from a permutation of its documents.
So neither the blocks of a source nor the documents of a block are ever many, also if one
source holds a third of all rows. Bisection runs on the table of sources, 31 exponents
(five halvings) a job, with nothing but sums brought to the driver.

Tokens are runs of characters that are not ASCII white space.

* Null text has no tokens. Documents without tokens are taken with the permutation's other
  documents. A source without tokens gets no weight, its documents no copy.
* Null source is a source of its own. Rows with equal ids are taken together; null ids are
  equal to each other. No rows or no tokens at all: no copies. Other columns are kept as
  they are by ``realise`` and ignored by ``decide``.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.sources.store import materialize

POINTS = 32
ROUNDS = 6
WORD = r"[^\\x20\\x09-\\x0D]+"


@dataclass
class Mix:
    exponent: float
    sources: DataFrame  # source_key, tokens, n_docs, n_blocks, weight, passes, rest
    blocks: DataFrame  # source_key, block, block_rank, whole, open
    chosen: DataFrame  # source_key, id_key: documents of open blocks that are still taken


def _id_key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _source_key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("-"))


def _block() -> Column:
    return F.expr("CAST(conv(substr(md5(id_key), 1, 8), 16, 10) AS BIGINT) % n_blocks")


def token_count(column: str) -> Column:
    return F.expr(f"CAST(regexp_count(coalesce(`{column}`, ''), '{WORD}') AS BIGINT)")


def exponent_for(sources: DataFrame, total: int, budget: int, entropy: float | None, repeats: float | None) -> float:
    """The least exponent of 0..1 that meets the limit, to 2**-30; 1 if none does."""
    shares = sources.where("tokens > 0").select((F.col("tokens") / F.lit(float(total))).alias("p"))
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (high - low) / POINTS
        at = [low + step * k for k in range(1, POINTS)]
        sums = shares.agg(*[
            f for k, a in enumerate(at) for f in (
                F.sum(F.pow("p", F.lit(a))).alias(f"z{k}"),
                F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias(f"y{k}"),
                F.max(F.pow("p", F.lit(a)) / F.col("p")).alias(f"m{k}"),
            )
        ]).first()

        def meets(k: int, a: float) -> bool:
            z = sums[f"z{k}"]
            if entropy is not None:
                return log(z) - a * sums[f"y{k}"] / z <= entropy
            return budget / total * sums[f"m{k}"] / z <= repeats

        good = next((k for k, a in enumerate(at) if meets(k, a)), None)
        low, high = (at[-1], high) if good is None else (at[good] - step, at[good])
    return high


def plan(docs: DataFrame, budget_ratio: float = 1.0, entropy: float | None = None, repeats: float | None = 1.25,
         id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> tuple[Mix, DataFrame]:
    """The mix, and the narrow rows (id, source, id_key, source_key, n_tokens) that it was made from.

    The budget is ``budget_ratio`` times all tokens. Give ``entropy`` (in nats) or ``repeats``.
    """
    rows = materialize(
        docs.select(
            F.col(id_column).alias("id"), F.col(source_column).alias("source"), _id_key(id_column).alias("id_key"),
            _source_key(source_column).alias("source_key"), token_count(text_column).alias("n_tokens"),
        ), "token-counts",
    )
    sources = materialize(rows.groupBy("source_key").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = int(budget_ratio * total)
    exponent = exponent_for(sources, total, budget, entropy, repeats) if total else 1.0
    raw = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(exponent))).otherwise(0.0)
    z = sources.agg(F.sum(raw)).first()[0] or 1.0
    share = F.floor(F.round(F.col("weight") * F.lit(float(budget)), 3)).cast("bigint")
    sources = sources.withColumn("weight", raw / F.lit(z)).withColumn("share", share).select(
        "source_key", "tokens", "n_docs", F.ceil(F.sqrt("n_docs")).cast("bigint").alias("n_blocks"), "weight",
        F.expr("IF(tokens > 0, share div tokens, 0L)").alias("passes"), F.expr("IF(tokens > 0, share % tokens, 0L)").alias("rest"),
        (F.col("tokens") == 0).alias("bare"),
    )
    sources = materialize(sources, "weights")
    in_blocks = rows.join(sources.where("NOT bare"), "source_key").withColumn("block", _block())
    order = Window.partitionBy("source_key").orderBy(F.expr("md5(concat(source_key, '/', block, '/', passes))"), "block")
    blocks = in_blocks.groupBy("source_key", "block", "passes", "rest").agg(F.sum("n_tokens").alias("size")).select(
        "*", F.row_number().over(order).alias("block_rank"), F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto")
    )
    blocks = blocks.withColumn("whole", F.col("upto") <= F.col("rest"))
    blocks = blocks.withColumn("open", ~F.col("whole") & (F.col("upto") - F.col("size") <= F.col("rest")))
    blocks = materialize(blocks, "blocks")
    first_open = blocks.where("open").groupBy("source_key").agg(F.min("block_rank").alias("block_rank"))
    opened = blocks.join(first_open, ["source_key", "block_rank"]).select("source_key", "block", (F.col("upto") - F.col("size")).alias("before"))
    inside = Window.partitionBy("source_key").orderBy(F.expr("md5(concat(id_key, '/', passes))"), "id_key")
    chosen = in_blocks.join(opened, ["source_key", "block"]).select(
        "source_key", "id_key", "rest", (F.col("before") + F.sum("n_tokens").over(inside)).alias("upto")
    ).where("upto <= rest").select("source_key", "id_key").distinct()
    blocks = blocks.select("source_key", "block", "block_rank", "whole")
    return Mix(exponent, sources, blocks, materialize(chosen, "chosen")), rows


def with_copies(rows: DataFrame, mix: Mix) -> DataFrame:
    """Adds ``block``, ``block_rank`` and ``copies`` to rows with ``id_key`` and ``source_key``.

    All joined tables are small (sources, blocks and open blocks); Spark broadcasts them if
    their written size allows and shuffles otherwise.
    """
    placed = rows.join(mix.sources.select("source_key", "n_blocks", "passes", "bare"), "source_key").withColumn("block", _block())
    ranked = placed.join(mix.blocks, ["source_key", "block"], "left")
    flagged = ranked.join(mix.chosen.withColumn("chosen", F.lit(True)), ["source_key", "id_key"], "left")
    copies = F.when(F.col("bare"), 0).otherwise(F.col("passes") + F.when(F.col("whole") | F.coalesce("chosen", F.lit(False)), 1).otherwise(0))
    return flagged.withColumn("copies", copies.cast("bigint"))


def decide(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", **options) -> DataFrame:
    """One row per document: id, source, ``n_tokens``, ``block``, ``block_rank`` and ``copies`` it has in the mix."""
    mix, rows = plan(docs, id_column=id_column, source_column=source_column, **options)
    return with_copies(rows, mix).select(F.col("id").alias(id_column), F.col("source").alias(source_column), "n_tokens", "block", "block_rank", "copies")


def realise(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", **options) -> DataFrame:
    """The documents as often as the mix has them, all columns kept."""
    mix, _ = plan(docs, id_column=id_column, source_column=source_column, **options)
    whole = docs.select(F.struct("*").alias("row"), _id_key(id_column).alias("id_key"), _source_key(source_column).alias("source_key"))
    taken = with_copies(whole, mix).where("copies > 0")
    return taken.select("row", F.explode(F.expr("sequence(1L, copies)"))).select("row.*")
