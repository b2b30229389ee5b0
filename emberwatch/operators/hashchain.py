"""Tamper-evident SHA-256 chains over events.

A chain is sequential by nature, so one chain over everything could only be built in one
task. Events are therefore chained in segments ``(chain_id, day, shard)``. The number of
shards of a chain and day follows from its counted events, so a segment gets about
``segment_size`` events per append however hot its chain is. Verification needs no order
at all: each record is checked against its stored predecessor by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.events import event_json
from emberwatch.schema import col

SEGMENT = ["chain_id", "day", "shard"]
SEGMENT_SIZE = 512


def canonical_event() -> Column:
    """The text that is hashed: all event fields and the raw record, keys sorted."""
    return event_json({"raw": F.col("raw_json")})


def _shard(uid: Column, shards: Column) -> Column:
    return F.conv(F.substring(F.sha2(uid, 256), 1, 8), 16, 10).cast("bigint") % shards


def append_chain(events: DataFrame, chain: str | Column = "computer", heads: DataFrame | None = None,
                 event_type: str = "event", segment_size: int = SEGMENT_SIZE) -> DataFrame:
    """Chain records for new events, continuing from ``heads`` (see :func:`chain_heads`)."""
    rows = events.select(
        col(chain).alias("chain_id"), F.to_date("event_ts").alias("day"), "event_ts", "event_uid",
        canonical_event().alias("payload_json"),
    )
    sizes = (
        events.groupBy(col(chain).alias("chain_id"), F.to_date("event_ts").alias("day"))
        .agg(F.ceil(F.count(F.lit(1)) / segment_size).cast("bigint").alias("shards"))
    )
    segments = (
        rows.join(sizes, ["chain_id", "day"])
        .withColumn("shard", _shard(F.col("event_uid"), F.col("shards")))
        .groupBy(*SEGMENT)
        .agg(F.array_sort(F.collect_list(F.struct("event_ts", "event_uid", "payload_json"))).alias("items"))
    )
    if heads is not None:
        segments = segments.join(heads.select(*SEGMENT, F.col("seq").alias("base"), F.col("event_hash").alias("head")), SEGMENT, "left")
    else:
        segments = segments.withColumns({"base": F.lit(0).cast("bigint"), "head": F.lit("")})
    segments = segments.withColumns(
        {"base": F.coalesce("base", F.lit(0).cast("bigint")), "head": F.coalesce("head", F.lit(""))}
    )
    links = F.expr(
        """aggregate(
             items,
             named_struct('last', head, 'out', cast(array() as array<string>)),
             (acc, e) -> named_struct(
               'last', sha2(concat(acc.last, e.payload_json), 256),
               'out', array_append(acc.out, sha2(concat(acc.last, e.payload_json), 256))),
             acc -> acc.out)"""
    )
    return (
        segments.withColumn("hashes", links)
        .withColumn("previous", F.concat(F.array("head"), F.slice("hashes", F.lit(1), F.size("hashes") - 1)))
        .select(*SEGMENT, "base", F.posexplode(F.arrays_zip("items", "hashes", "previous")).alias("pos", "z"))
        .select(
            *SEGMENT, (F.col("base") + F.col("pos") + 1).alias("seq"), F.lit(event_type).alias("event_type"),
            F.col("z.items.event_uid").alias("event_uid"), F.col("z.hashes").alias("event_hash"),
            F.col("z.previous").alias("previous_hash"), F.col("z.items.payload_json").alias("payload_json"),
        )
    )


def chain_heads(records: DataFrame) -> DataFrame:
    """Last record of every segment: keep this small table elsewhere to notice cut-off tails."""
    return records.groupBy(*SEGMENT).agg(
        F.max("seq").alias("seq"), F.max_by("event_hash", "seq").alias("event_hash"), F.count(F.lit(1)).alias("records")
    )


def verify_chain(records: DataFrame) -> DataFrame:
    """Records that fail: ``hash_mismatch`` and/or ``link_mismatch``. Empty means intact."""
    before = records.select(*SEGMENT, (F.col("seq") + 1).alias("seq"), F.col("event_hash").alias("actual_previous"))
    checked = records.join(before, [*SEGMENT, "seq"], "left").withColumn(
        "actual_previous", F.coalesce("actual_previous", F.lit(""))
    )
    return (
        checked.withColumn(
            "hash_mismatch", F.sha2(F.concat("actual_previous", "payload_json"), 256) != F.col("event_hash")
        )
        .withColumn("link_mismatch", F.col("previous_hash") != F.col("actual_previous"))
        .where(F.col("hash_mismatch") | F.col("link_mismatch"))
        .select(*SEGMENT, "seq", "hash_mismatch", "link_mismatch")
    )


def verify_heads(records: DataFrame, heads: DataFrame) -> DataFrame:
    """Segments whose last record is not the kept head any more."""
    now = chain_heads(records).select(*SEGMENT, F.col("seq").alias("now_seq"), F.col("event_hash").alias("now_hash"))
    return heads.join(now, SEGMENT, "left").where(
        ~F.coalesce((F.col("seq") == F.col("now_seq")) & (F.col("event_hash") == F.col("now_hash")), F.lit(False))
    ).select(*SEGMENT, "seq", "now_seq")
