"""Syslog lines (RFC 5424, RFC 3164) and CEF lines.

Each line format is one regular expression. All groups come out of a single match: the
match is rewritten with line feeds between the groups, which cannot occur inside a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions.events import cef_category, cef_unescape
from emberwatch.functions.text import message_category, message_event_id, message_ip, message_user
from emberwatch.functions.timestamps import cef_time, or_unknown, syslog_time
from emberwatch.schema import computed_once, first_text, normalize_events
from emberwatch.sources.lines import line_uid, read_lines

# Line formats. (?U) gives word and space classes their Unicode meaning,
# (?s) lets the message run to the end of the line whatever it contains.
RFC5424 = r"(?sU)^<(\d{1,3})>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.*)$"
RFC3164 = (
    r"(?sU)^(?:<(\d{1,3})>)?(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.*)$"
)
CEF = r"(?sU)^CEF:(\d+)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"
# Loops over the characters between escapes, so long values need no deep recursion.
CEF_PAIR = r"(?sU)(\w+)=([^\\=]*?(?:\\.[^\\=]*?)*?)(?=\s+\w+=|$)"
BSD_CLOCK_IN_HEADER = r"(?U)(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"


def _groups(text: Column, pattern: str, count: int) -> Column:
    """All groups of the match as an array inside an array, which is empty if the line does not match.

    The leading line feed, which no line has, tells a rewritten line from an unmatched one.
    """
    rewritten = F.split(F.regexp_replace(text, pattern, "\n" + "\n".join(f"${i}" for i in range(1, count + 1))), "\n", count + 1)
    return F.filter(F.array(rewritten), lambda g: F.size(g) == count + 1)


# Position of the named parts in the group arrays (0 is the marker).
PARTS_5424 = ["pri", "version", "time", "host", "app", "procid", "msgid", "message"]
PARTS_3164 = ["pri", "time", "host", "app", "pid", "message"]
PARTS_CEF = ["version", "vendor", "product", "device_version", "signature_id", "name", "severity", "extension_text"]
PARTS = sorted({*PARTS_5424, *PARTS_3164, *PARTS_CEF})


def _parts(text: Column, pattern: str, names: list[str], kind: str) -> Column:
    """Named parts of a match as a struct with the same fields for every line format; NULL without a match.

    The groups are bound to a name first, so the line is matched once and not once for each part.
    """
    at = {name: i + 1 for i, name in enumerate(names)}

    def named(groups: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), *[F.get(groups, F.lit(at.get(name, -1))).alias(name) for name in PARTS])

    return F.get(F.transform(_groups(text, pattern, len(names)), named), F.lit(0))


def cef_pairs(extension: Column) -> Column:
    """Extension text to a map; of a repeated key the last value counts."""
    keys = F.regexp_extract_all(extension, F.lit(CEF_PAIR), F.lit(1))
    values = F.regexp_extract_all(extension, F.lit(CEF_PAIR), F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    return F.aggregate(
        pairs,
        F.create_map().cast("map<string,string>"),
        lambda m, p: F.map_concat(
            F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], cef_unescape(F.trim(p["v"])))
        ),
    )


def match_lines(lines: DataFrame, cef_only: bool = False) -> DataFrame:
    """Lines with their ``kind`` and named parts; kind is NULL for lines of no known format.

    A line is tried as RFC 5424, then RFC 3164, then CEF; the first that fits counts.
    """
    value = F.col("value")
    cef_part = F.when(value.contains("CEF:"), F.expr("substring(value, instr(value, 'CEF:'))"))
    tries = [] if cef_only else [
        _parts(value, RFC5424, PARTS_5424, "rfc5424"),
        _parts(value, RFC3164, PARTS_3164, "rfc3164"),
    ]
    tries.append(_parts(cef_part, CEF, PARTS_CEF, "cef"))
    matched = computed_once(lines, p=F.coalesce(*tries))
    return matched.select("value", "src_file", "line_id", "p.*")


def line_events(matched: DataFrame, year: int) -> DataFrame:
    """Event layout of matched lines, all formats in one projection."""
    is_cef = F.col("kind") == "cef"
    df = computed_once(
        matched,
        ext=F.when(is_cef, cef_pairs(F.col("extension_text"))),
        header=F.when(is_cef, F.trim(F.substring("value", F.lit(1), F.instr("value", "CEF:") - 1))),
    )

    def ext(*keys: str, default: Column | None = None) -> Column:
        # A key that is present counts even if its value is empty.
        found = [F.try_element_at("ext", F.lit(k)) for k in keys]
        return F.coalesce(*found, default if default is not None else F.lit(""))

    def pick(cef: Column, log: Column) -> Column:
        return F.when(is_cef, cef).otherwise(log)

    clock = F.regexp_extract("header", BSD_CLOCK_IN_HEADER, 1)
    stamp = ext("rt", "end", "start")
    priority = F.coalesce(F.col("pri").try_cast("int"), F.lit(0))
    df = computed_once(
        df,
        ts=pick(cef_time(F.when(stamp != "", stamp).otherwise(clock), year), syslog_time("time", year)),
    )
    second_word = F.coalesce(F.get(F.split("header", r"\s+"), F.lit(1)), F.lit(""))
    raw_syslog = F.to_json(
        F.struct(
            "app", F.col("kind").alias("format"), F.col("host").alias("hostname"), "message", "msgid", "pid",
            priority.alias("priority"), "procid",
            F.when(F.col("kind") == "rfc5424", F.col("version").try_cast("int")).alias("version"),
        )
    )
    raw_cef = F.to_json(
        F.struct(
            F.col("version").alias("cef_version"), "device_version", F.col("ext").alias("extension"),
            F.col("kind").alias("format"), "name", "product", "severity", "signature_id", "vendor",
        )
    )
    nothing = F.lit("")
    return normalize_events(
        df.select(
            line_uid().alias("event_uid"), or_unknown(F.col("ts")).alias("event_ts"), F.col("ts").isNotNull().alias("ts_valid"),
            pick(F.coalesce(F.trim("signature_id").try_cast("int"), F.lit(0)), message_event_id("message", priority)).alias("event_id"),
            pick(F.concat_ws("/", "vendor", "product"), F.col("app")).alias("source"),
            pick(cef_category("severity"), message_category("message")).alias("category"),
            pick(first_text(ext("dhost", "shost"), second_word), F.col("host")).alias("computer"),
            pick(ext("suser"), message_user("message")).alias("username"),
            pick(ext("src", "sourceAddress"), message_ip("message")).alias("source_ip"),
            pick(ext("dproc", "sproc"), F.col("app")).alias("process_name"),
            pick(ext("act", "cs1", default=F.col("name")), F.col("message")).alias("command_line"),
            pick(ext("duser"), nothing).alias("target_username"), pick(ext("dntdom"), nothing).alias("domain"),
            pick(raw_cef, raw_syslog).alias("raw_json"),
        )
    )


def parse_lines(lines: DataFrame, default_year: int, cef_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) of (value, src_file, line_id) lines."""
    matched = match_lines(lines, cef_only)
    bad = matched.where(F.col("kind").isNull()).select("value", "src_file", "line_id", F.lit("malformed").alias("reason"))
    return line_events(matched.where(F.col("kind").isNotNull()), default_year), bad


def read_syslog(spark: SparkSession, path: str, default_year: int, **options: str) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) of syslog files; ``default_year`` dates year-less lines."""
    return parse_lines(read_lines(spark, path, **options), default_year)


def read_cef(spark: SparkSession, path: str, default_year: int, **options: str) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) of CEF files."""
    return parse_lines(read_lines(spark, path, **options), default_year, cef_only=True)
