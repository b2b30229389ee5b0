"""Exported Windows event XML: ``<Event>`` elements in files of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.schema import computed_once
from emberwatch.sources.json_logs import good_numbers, record_events, record_fields
from emberwatch.sources.lines import numbered, read_lines

EVENT_SCHEMA = """
  System struct<
    Provider: struct<_Name: string>,
    EventID: struct<_VALUE: string, _Qualifiers: string>,
    TimeCreated: struct<_SystemTime: string>,
    Computer: string,
    Channel: string>,
  EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>,
  UserData map<string, map<string, string>>,
  _corrupt string
"""

# The XML reader knows fewer aliases than the JSON reader.
XML_KEYS = {
    "username": ["SubjectUserName", "User"],
    "domain": ["TargetDomainName", "SubjectDomainName"],
    "source_ip": ["IpAddress", "SourceAddress"],
    "process_name": ["NewProcessName", "Image", "ProcessName"],
    "command_line": ["CommandLine"],
    "logon_type": ["LogonType"],
    "status": ["Status", "Keywords"],
    "parent_process": ["ParentImage", "ParentProcessName"],
    "target_username": ["TargetUserName"],
    "event_id": ["EventID"],
    "time": ["TimeCreated"],
    "source": ["Source"],
    "computer": ["Computer"],
}


# In the layout ``lines``: an event element, and what may stand around the elements.
EVENT_LINE = r"^<([\w.-]+:)?Event[ >]"
FRAME_LINE = r"^(<\?xml|<!--|</?([\w.-]+:)?Events[ >])"


def _named_data():
    """``EventData`` as a map; without named data, the children of ``UserData``."""
    named = F.filter("EventData.Data", lambda d: F.coalesce(d["_Name"], F.lit("")) != "")
    # Of a repeated name the last value counts.
    as_map = F.aggregate(
        F.coalesce(named, F.array().cast("array<struct<_Name:string,_VALUE:string>>")),
        F.create_map().cast("map<string,string>"),
        lambda m, d: F.map_concat(
            F.map_filter(m, lambda k, _: k != d["_Name"]), F.create_map(d["_Name"], F.coalesce(d["_VALUE"], F.lit("")))
        ),
    )
    first_block = F.get(F.map_values("UserData"), F.lit(0))
    user = F.transform_values(first_block, lambda _, v: F.coalesce(v, F.lit("")))
    return F.when(F.size(as_map) > 0, as_map).otherwise(user)


def read_event_xml(spark: SparkSession, path: str, layout: str = "documents", **options: str) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) of XML exports.

    ``layout`` is ``documents`` (well-formed files, one task per file) or ``lines`` (one
    ``<Event>`` element per line; long files are split over many tasks; lines that are no
    event and no frame of the export are set aside).
    """
    if layout == "lines":
        lines = read_lines(spark, path, **options).where(~F.col("value").rlike(FRAME_LINE))
        stray = lines.where(~F.col("value").rlike(EVENT_LINE)).select("value", "src_file", "line_id", F.lit("malformed").alias("reason"))
        lines = lines.where(F.col("value").rlike(EVENT_LINE))
        parsed = F.from_xml("value", EVENT_SCHEMA, {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "_corrupt"})
        xml = computed_once(lines, e=parsed).select("e.*", "src_file", "line_id")
    else:
        stray = None
        xml = numbered(
            spark.read.format("xml").options(**options).option("rowTag", "Event").option("ignoreNamespace", True)
            .option("columnNameOfCorruptRecord", "_corrupt").schema(EVENT_SCHEMA).load(path)
        )
    data = _named_data()
    record = F.struct(
        F.coalesce("System.Provider._Name", F.lit("")).alias("Source"),
        F.coalesce("System.EventID._VALUE", F.lit("0")).alias("EventID"),
        F.coalesce("System.TimeCreated._SystemTime", F.lit("")).alias("TimeCreated"),
        F.coalesce("System.Computer", F.lit("")).alias("Computer"),
        F.coalesce("System.Channel", F.lit("")).alias("Channel"),
        F.when(F.size(data) > 0, data).alias("EventData"),
    )
    rows = xml.select(F.to_json(record).alias("value"), "src_file", "line_id", "_corrupt")
    rows = computed_once(rows, raw=F.try_parse_json("value"))
    fields = record_fields(rows, XML_KEYS)
    # A record without a readable event id keeps id 0; only broken XML and logon types are set aside.
    fields = fields.withColumn("event_id", F.coalesce(F.col("event_id").try_cast("int"), F.lit(0)).cast("string"))
    ok = F.col("_corrupt").isNull() & good_numbers()
    bad = fields.where(~ok).select(
        F.coalesce("_corrupt", "value").alias("value"), "src_file", "line_id",
        F.when(F.col("_corrupt").isNotNull(), "malformed").otherwise("bad number").alias("reason"),
    )
    return record_events(fields.where(ok).drop("_corrupt")), bad if stray is None else bad.unionByName(stray)
