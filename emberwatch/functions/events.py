"""Record-to-event functions: field lookup, categories, levels, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberwatch.functions.sqltext import lit
from emberwatch.functions.text import contains_any, first_match
from emberwatch.schema import col, ts_iso

# Event id to category.
EVENT_CATEGORIES = {
    4624: "authentication", 4625: "authentication", 4634: "authentication",
    4648: "authentication", 4776: "authentication",
    1: "process", 4688: "process", 4689: "process",
    4672: "privilege", 4673: "privilege", 4674: "privilege",
    3: "network", 5156: "network", 5157: "network",
    11: "file", 4663: "file",
    12: "registry", 13: "registry",
}

# CEF severity digit to category.
CEF_CATEGORIES = {
    "0": "unknown", "1": "unknown", "2": "unknown",
    "3": "authentication", "4": "authentication",
    "5": "network", "6": "process",
    "7": "privilege", "8": "privilege", "9": "privilege", "10": "privilege",
}

# SIEM rule level bounds and the level written back per severity.
LEVEL_BOUNDS = [(15, "critical"), (12, "high"), (7, "medium"), (4, "low")]
SEVERITY_LEVELS = {"low": 3, "medium": 7, "high": 12, "critical": 15}
OTHER_LEVEL = 5

# Where a DNS query name may stand in a record.
QUERY_KEYS = ["QueryName", "query_name", "query", "dns_query", "Name", "name"]
QUERY_EVENT_DATA_KEYS = ["QueryName", "Query", "Name"]

# The fields an event fingerprint covers.
FINGERPRINT_FIELDS = [
    "agent_id", "agent_name", "category", "command_line", "computer", "domain",
    "event_id", "event_source", "logon_type", "mitre_tactic", "mitre_technique",
    "parent_process", "process_name", "source", "source_ip", "status",
    "target_username", "timestamp", "username",
]


def json_path(*parts: str) -> str:
    return "$" + "".join(f"['{p}']" for p in parts)


def raw_text(raw: Column, *parts: str) -> Column:
    """Text at a path of a VARIANT; NULL if missing, null or not a scalar."""
    return F.try_variant_get(raw, json_path(*parts), "string")


def raw_text_sql(raw: str, *parts: str) -> str:
    return f"try_variant_get({raw}, {lit(json_path(*parts))}, 'string')"


def first_field(raw: str, *keys: str, default: str = "") -> Column:
    """First key of the VARIANT column present at the top level or under ``EventData``, key by key."""
    tries = [x for k in keys for x in (raw_text_sql(raw, k), raw_text_sql(raw, "EventData", k))]
    return F.expr(f"coalesce({', '.join(tries)}, {lit(default)})")


# First value in JSON text that is not blank: a string that is no key, a number or a flag.
LEAF = r'[:\[,]("(?!\s*")(?:[^"\\]++|\\.)*+"(?!:)|-?\d[\d.eE+-]*|true|false)'


def path_texts(raw: str, paths: list[str]) -> Column:
    """Array with the text at each dotted path of the VARIANT column; of a list or object its first leaf.

    VARIANT keeps the keys of an object sorted, so "first" is by key there. Missing or
    blank is NULL.
    """
    nodes = ", ".join(f"try_variant_get({raw}, {lit(json_path(*p.split('.')))}, 'variant')" for p in paths)
    text, kind = "try_variant_get(v, '$', 'string')", "schema_of_variant(v)"
    leaf = f"trim(try_variant_get(try_parse_json(nullif(regexp_extract({text}, {lit(LEAF)}, 1), '')), '$', 'string'))"
    return F.expr(
        f"transform(array({nodes}), v -> nullif(CASE WHEN {kind} LIKE 'ARRAY%' OR {kind} LIKE 'OBJECT%' THEN {leaf} ELSE {text} END, ''))"
    )


def first_path(raw: str, *paths: str, default: str = "") -> Column:
    """First non-empty text among the dotted paths."""
    found = F.array_compact(path_texts(raw, list(paths)))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(default))


def dns_query_sql(raw: str) -> str:
    """SQL for the query name; ``raw`` (a VARIANT expression) is evaluated once."""
    tries = [raw_text_sql("r", k) for k in QUERY_KEYS]
    tries += [raw_text_sql("r", "EventData", k) for k in QUERY_EVENT_DATA_KEYS]
    found = f"filter(array({', '.join(tries)}), x -> x IS NOT NULL AND x <> '')"
    return f"coalesce(get(transform(array({raw}), r -> get({found}, 0)), 0), '')"


def dns_query(raw: str) -> Column:
    """Query name of a DNS record (a VARIANT column), ``''`` if it has none."""
    return F.expr(dns_query_sql(raw))


def _lookup(table: dict, key: Column, default: str) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def event_category(event_id: str | Column) -> Column:
    return _lookup(EVENT_CATEGORIES, col(event_id), "unknown")


def cef_category(severity: str | Column) -> Column:
    return _lookup(CEF_CATEGORIES, col(severity), "unknown")


def level_severity(level: str | Column) -> Column:
    return first_match([(col(level) >= bound, name) for bound, name in LEVEL_BOUNDS], "info")


def severity_level(severity: str | Column) -> Column:
    pairs = [F.lit(x) for item in SEVERITY_LEVELS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(severity)), F.lit(OTHER_LEVEL))


def channel_category(channel: str | Column, event_id: str | Column, message: str | Column) -> Column:
    """Category from id sets and keywords; the order of the tests matters."""
    channel, event_id, text = F.lower(col(channel)), col(event_id), F.lower(col(message))
    return first_match(
        [
            (event_id.isin(4624, 4625, 4648, 4776) | contains_any(text, ["logon", "authentication"]), "authentication"),
            (
                event_id.isin(4688, 4689, 1) | channel.contains("powershell")
                | contains_any(text, ["process", "command"]),
                "process",
            ),
            (event_id.isin(3, 5156, 5157) | contains_any(text, ["network", "connection"]), "network"),
            (event_id.isin(11, 4663), "file"),
            (event_id.isin(12, 13), "registry"),
            (event_id.isin(4672, 4673, 4674) | contains_any(text, ["privilege", "admin"]), "privilege"),
        ],
        "unknown",
    )


def shape_category(event_id, process_name, command_line, source_ip, username) -> Column:
    """Category from which fields are filled."""
    return first_match(
        [
            ((col(process_name) != "") | (col(command_line) != ""), "process"),
            (col(source_ip) != "", "network"),
            (col(event_id).isin(4624, 4625, 4648, 4776) | (col(username) != ""), "authentication"),
        ],
        "unknown",
    )


def cef_unescape(value: str | Column) -> Column:
    """Undo CEF escapes one after the other, in the order the format's readers apply them."""
    value = col(value)
    for escaped, plain in [("\\=", "="), ("\\\\", "\\"), ("\\n", "\n"), ("\\r", "\r")]:
        value = F.replace(value, F.lit(escaped), F.lit(plain))
    return value


def event_json(extra: dict[str, Column] | None = None) -> Column:
    """Canonical JSON of an event: sorted keys, no raw record unless added by ``extra``."""
    fields = {name: F.col(name) for name in FINGERPRINT_FIELDS if name != "timestamp"}
    fields["timestamp"] = ts_iso("event_ts")
    fields.update(extra or {})
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]))


def event_fingerprint() -> Column:
    return F.sha2(event_json(), 256)
