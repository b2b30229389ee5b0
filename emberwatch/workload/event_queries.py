"""Queries over single functions, windows, rules and the hash chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.functions import events as ev
from emberwatch.functions import text as tx
from emberwatch.functions.network import is_private_ip
from emberwatch.operators import hashchain, windows
from emberwatch.operators.bursts import FAILED, REMOTE, STAGE, STAGES, target_or_user
from emberwatch.operators.stateless import QUIET
from emberwatch.operators.fieldrules import FieldRule, field_rule_alerts, split_field_rules
from emberwatch.operators.rowrules import run_row_rules
from emberwatch.operators.sigma import detect_sigma
from emberwatch.schema import computed_once, ts_text
from emberwatch.sources import store
from emberwatch.workload.alert_sql import (
    BS, ENTROPY, KEYED_SQL, LEAF, PARENT, PRIVATE, QUERY, SETTINGS, TOOL, VIEW, lit, window_ctes,
)
from emberwatch.workload.queries import alert_view, register
from emberwatch.workload.tables import SEC_EVENTS_CTE, sec_events, table


def over_events(select: str, ctes: str = "") -> str:
    return f"WITH RECURSIVE {SEC_EVENTS_CTE}{', ' + ctes if ctes else ''} {select}"


# ---- scalar functions over events and texts --------------------------------------------


@register("event_category", over_events("SELECT event_uid, category FROM sec_events"))
def event_category(spark, sf_dir):
    return sec_events(spark, sf_dir).select("event_uid", ev.event_category("event_id").alias("category"))


def _message_sql(table_name: str, key: str) -> str:
    low = "lower(text)"
    category = "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains({low}, {lit(w)})" for w in words) + f" THEN '{name}'"
        for name, words in tx.MESSAGE_KEYWORDS.items()
    ) + " ELSE 'unknown' END"
    ids = "CASE " + " ".join(f"WHEN regexp_matches(text, {lit(p)}, 'i') THEN {n}" for p, n in tx.MESSAGE_EVENT_IDS) + " ELSE 0 END"
    # RE2 classes are ASCII: spell word and space characters out as Unicode classes.
    wide = [p.replace(r"(\w+)", r"([\pL\pM\pN_]+)").replace(r"\s+", r"[\s\pZ]+").replace(r"\S+", r"[^\s\pZ]+") for p in tx.USER_PATTERNS]
    user = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {lit(p)}, 1, 'i'), '')" for p in wide) + ", '')"
    return (
        f"SELECT {key}, {category} AS category, CAST({ids} AS BIGINT) AS event_id, {user} AS username, "
        f"regexp_extract(text, {lit(tx.IP_PATTERN)}, 1) AS ip FROM {table_name}"
    )


def _message_columns(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys, tx.message_category("text").alias("category"),
        tx.message_event_id("text", F.lit(0)).cast("bigint").alias("event_id"),
        tx.message_user("text").alias("username"), tx.message_ip("text").alias("ip"),
    )


@register("document_messages", _message_sql("documents", "doc_id"))
def document_messages(spark, sf_dir):
    return _message_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@register("conversation_messages", _message_sql("conversations", "conv_id, turn"))
def conversation_messages(spark, sf_dir):
    return _message_columns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")


_HOST = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"


@register(
    "host_label_entropy",
    f"SELECT page_id, label, CAST(round(CASE WHEN label = '' THEN 0 ELSE {ENTROPY} END, 6) + 0.0 AS DOUBLE) AS entropy, "
    f"{PARENT} AS parent FROM (SELECT page_id, {_HOST} AS query, split_part({_HOST}, '.', 1) AS label FROM pages)",
)
def host_label_entropy(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select("page_id", F.expr(_HOST).alias("query"))
    hosts = computed_once(hosts, label=tx.first_label("query"))
    return hosts.select(
        "page_id", "label", (F.round(tx.label_entropy("label"), 6) + 0.0).alias("entropy"), tx.parent_domain("query").alias("parent")
    )


_IP_EXPR = (
    "CAST((event_id * 7919 + user_id) % 256 AS STRING) || '.' || CAST((event_id * 31) % 256 AS STRING) || '.' || "
    "CAST((event_id * 17) % 128 AS STRING) || '.' || CAST(event_id % 256 AS STRING)"
)


@register(
    "private_ip",
    f"SELECT source_ip, {PRIVATE} AND source_ip NOT IN ('192.0.0.9', '192.0.0.10') AS is_private, count(*) AS n "
    f"FROM (SELECT {_IP_EXPR} AS source_ip FROM events) GROUP BY 1, 2",
)
def private_ip(spark, sf_dir):
    ips = table(spark, sf_dir, "events").select(F.expr(_IP_EXPR).alias("source_ip"))
    return ips.groupBy("source_ip").agg(F.count(F.lit(1)).alias("n")).select(
        "source_ip", is_private_ip("source_ip").alias("is_private"), "n"
    )


@register(
    "severity_levels",
    over_events(
        "SELECT level, severity, CASE severity WHEN 'low' THEN 3 WHEN 'medium' THEN 7 WHEN 'high' THEN 12 WHEN 'critical' THEN 15 ELSE 5 END::BIGINT AS back, "
        "count(*) AS n FROM (SELECT level, CASE WHEN level >= 15 THEN 'critical' WHEN level >= 12 THEN 'high' WHEN level >= 7 THEN 'medium' "
        "WHEN level >= 4 THEN 'low' ELSE 'info' END AS severity FROM (SELECT (event_id % 17)::BIGINT AS level FROM sec_events)) GROUP BY 1, 2, 3"
    ),
)
def severity_levels(spark, sf_dir):
    level = (F.col("event_id") % 17).cast("bigint")
    df = sec_events(spark, sf_dir).select(level.alias("level"), ev.level_severity(level).alias("severity"))
    return df.groupBy("level", "severity").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "back", ev.severity_level("severity").cast("bigint")
    )


_CHANNEL = (
    "CASE WHEN event_id IN (4624, 4625, 4648, 4776) OR contains(m, 'logon') OR contains(m, 'authentication') THEN 'authentication' "
    "WHEN event_id IN (4688, 4689, 1) OR contains(lower(source), 'powershell') OR contains(m, 'process') OR contains(m, 'command') THEN 'process' "
    "WHEN event_id IN (3, 5156, 5157) OR contains(m, 'network') OR contains(m, 'connection') THEN 'network' "
    "WHEN event_id IN (11, 4663) THEN 'file' WHEN event_id IN (12, 13) THEN 'registry' "
    "WHEN event_id IN (4672, 4673, 4674) OR contains(m, 'privilege') OR contains(m, 'admin') THEN 'privilege' ELSE 'unknown' END"
)
_SHAPE = (
    "CASE WHEN process_name <> '' OR command_line <> '' THEN 'process' WHEN source_ip <> '' THEN 'network' "
    "WHEN event_id IN (4624, 4625, 4648, 4776) OR username <> '' THEN 'authentication' ELSE 'unknown' END"
)


@register(
    "category_rules",
    over_events(
        f"SELECT event_uid, {_CHANNEL} AS by_channel, {_SHAPE} AS by_shape FROM "
        "(SELECT *, lower(process_name || ' ' || command_line || ' ' || raw_json) AS m FROM sec_events)"
    ),
)
def category_rules(spark, sf_dir):
    df = sec_events(spark, sf_dir)
    message = F.concat_ws(" ", "process_name", "command_line", "raw_json")
    return df.select(
        "event_uid", ev.channel_category("source", "event_id", message).alias("by_channel"),
        ev.shape_category("event_id", "process_name", "command_line", "source_ip", "username").alias("by_shape"),
    )


@register("tool_names", over_events(f"SELECT event_uid, {LEAF} AS leaf, {TOOL} AS tool FROM sec_events WHERE process_name <> ''"))
def tool_names(spark, sf_dir):
    df = sec_events(spark, sf_dir).where(F.col("process_name") != "")
    return df.select("event_uid", tx.path_leaf("process_name").alias("leaf"), tx.tool_name("process_name").alias("tool"))


@register(
    "record_fields",
    over_events(
        f"SELECT event_uid, {QUERY} AS query, coalesce(json_extract_string(raw_json, '$.k'), '') AS k, "
        "coalesce(json_extract_string(raw_json, '$.EventData.PrivilegeList'), json_extract_string(raw_json, '$.EventData.Note'), '') AS first_field, "
        "coalesce(TRY_CAST(json_extract_string(raw_json, '$.EventData.Note') AS DOUBLE), 0.0) AS as_number FROM sec_events"
    ),
)
def record_fields(spark, sf_dir):
    df = computed_once(sec_events(spark, sf_dir).select("event_uid", "raw_json"), raw=F.try_parse_json("raw_json"))
    return df.select(
        "event_uid", ev.dns_query("raw").alias("query"), ev.first_field("raw", "k").alias("k"),
        ev.first_field("raw", "PrivilegeList", "Note").alias("first_field"),
        tx.number_or_zero(ev.first_field("raw", "Note")).alias("as_number"),
    )


_FINGER = (
    "sha256(json_object('agent_id', '', 'agent_name', '', 'category', category, 'command_line', command_line, 'computer', computer, "
    "'domain', \"domain\", 'event_id', event_id, 'event_source', '', 'logon_type', logon_type, 'mitre_tactic', '', 'mitre_technique', '', "
    "'parent_process', parent_process, 'process_name', process_name, {raw}'source', source, 'source_ip', source_ip, 'status', status, "
    "'target_username', target_username, 'timestamp', CASE WHEN microsecond(event_ts) % 1000000 = 0 THEN strftime(event_ts, '%Y-%m-%dT%H:%M:%S') "
    "ELSE strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%f') END, 'username', username)::VARCHAR{tail}"
)


@register("event_fingerprint", over_events("SELECT event_uid, " + _FINGER.replace("{raw}", "").replace("{tail}", ")") + " AS fingerprint FROM sec_events"))
def event_fingerprint(spark, sf_dir):
    return sec_events(spark, sf_dir).select("event_uid", ev.event_fingerprint().alias("fingerprint"))


@register(
    "count_by_field",
    over_events("SELECT source_ip AS value, count(*) AS n FROM sec_events WHERE source_ip <> '' GROUP BY 1"),
)
def count_by_field(spark, sf_dir):
    return windows.count_by_field(sec_events(spark, sf_dir), "source_ip")


# ---- windows ---------------------------------------------------------------------------


def _window_view(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key", "anchor").agg(
        ts_text(F.min("event_ts")).alias("first_time"), F.count(F.lit(1)).alias("n")
    ).drop("anchor")


def _windows_sql(name: str, where: str, key: str, width: int, minimum: int) -> str:
    return over_events(
        f"SELECT gk AS key, strftime(min(event_ts), '%Y-%m-%d %H:%M:%S') AS first_time, count(*) AS n FROM {name}_rows GROUP BY gk, w",
        f"{name} AS (SELECT *, {key} AS gk FROM sec_events WHERE {where}), " + window_ctes(name, name, width, minimum),
    )


@register("dense_windows", _windows_sql("dw", "event_id IN (4625, 4776)", "computer", 14400, 3))
def dense_windows(spark, sf_dir):
    return _window_view(windows.dense_windows(sec_events(spark, sf_dir).where(FAILED), "computer", 14400, 3))


@register("anchored_windows", _windows_sql("aw", "event_id >= 0", "username", 3600, 1))
def anchored_windows(spark, sf_dir):
    return _window_view(windows.anchored_windows(sec_events(spark, sf_dir), "username", 3600))


@register("hot_key_windows", _windows_sql("hk", "event_id IN (4625, 4776)", "'all'", 3600, 4))
def hot_key_windows(spark, sf_dir):
    """All failed logons under one key: the whole table is one hot group."""
    return _window_view(windows.dense_windows(sec_events(spark, sf_dir).where(FAILED), F.lit("all"), 3600, 4))


@register(
    "stage_windows",
    over_events(
        "SELECT gk AS key, strftime(w, '%Y-%m-%d %H:%M:%S') AS first_time, count(*) AS n, count(DISTINCT stage) AS stages FROM ac_rows GROUP BY gk, w",
        KEYED_SQL["attack_chain"][0],
    ),
)
def stage_windows(spark, sf_dir):
    staged = sec_events(spark, sf_dir).withColumn("stage", F.expr(STAGE)).where(f"stage IS NOT NULL AND NOT {QUIET}")
    rows = windows.first_stage_window(
        staged, target_or_user(), "stage", STAGES, SETTINGS.chain_window, SETTINGS.chain_min_stages
    )
    return rows.groupBy("key").agg(
        ts_text(F.min("event_ts")).alias("first_time"), F.count(F.lit(1)).alias("n"), F.count_distinct("stage").alias("stages")
    )


@register(
    "prefix_window",
    over_events(
        "SELECT username, count(*) AS n FROM (SELECT username, event_ts, min(event_ts) OVER (PARTITION BY username) AS f FROM sec_events) "
        "WHERE event_ts <= f + INTERVAL 86400 SECOND GROUP BY 1"
    ),
)
def prefix_window(spark, sf_dir):
    rows = windows.prefix_window(sec_events(spark, sf_dir), ["username"], "event_ts", 86400)
    return rows.groupBy("username").agg(F.count(F.lit(1)).alias("n"))


@register(
    "remote_logon_hosts",
    over_events(
        "SELECT gk AS username, count(*) AS n, count(DISTINCT computer) AS hosts FROM lm GROUP BY 1",
        KEYED_SQL["lateral_movement"][0].split(", lm_c AS")[0],
    ),
)
def remote_logon_hosts(spark, sf_dir):
    """Whole-group window: one group per account, no time limit."""
    rows = sec_events(spark, sf_dir).where(REMOTE)
    return rows.groupBy(target_or_user().alias("username")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("computer").alias("hosts")
    )


# ---- user rules ------------------------------------------------------------------------


def _rule(name, conditions, **more):
    return {"name": name, "description": f"{name} seen", "severity": "medium", "mitre_technique": "T0000",
            "conditions": [dict(zip(("field", "operator", "value"), c)) for c in conditions], **more}


# (rule, SQL of its conditions)
EVENT_RULES = [
    (_rule("r-equals", [("username", "equals", "SYSTEM"), ("event_id", "equals", 4625)]), "lower(username) = 'system' AND event_id = 4625"),
    (_rule("r-not-equals", [("category", "not_equals", "UNKNOWN"), ("event_id", "in", [11, "4634"])]), "category <> 'unknown' AND event_id IN (11, 4634)"),
    (_rule("r-contains", [("command_line", "contains", "PSEXEC")]), "contains(lower(command_line), 'psexec')"),
    (_rule("r-not-contains", [("command_line", "not_contains", "e"), ("process_name", "endswith", ".EXE")]),
     "NOT contains(lower(command_line), 'e') AND lower(process_name) LIKE '%.exe'"),
    (_rule("r-startswith", [("process_name", "startswith", "c:\\windows"), ("logon_type", "lte", 0)]),
     f"starts_with(lower(process_name), 'c:' || {BS} || 'windows') AND logon_type <= 0"),
    (_rule("r-regex", [("command_line", "regex", r"net\s+(user|localgroup)")]), r"regexp_matches(command_line, 'net\s+(user|localgroup)', 'i')"),
    (_rule("r-numbers", [("event_id", "gt", 5000), ("event_id", "lt", "5002"), ("logon_type", "gte", "x")]), "event_id > 5000 AND event_id < 5002 AND logon_type >= 0"),
    (_rule("r-raw-path", [("raw.EventData.TicketEncryptionType", "equals", "0x17")]), "json_extract_string(raw_json, '$.EventData.TicketEncryptionType') = '0x17'"),
    (_rule("r-raw-key", [("k", "equals", "13"), ("ImagePath", "not_equals", "")]),
     "json_extract_string(raw_json, '$.k') = '13' AND coalesce(json_extract_string(raw_json, '$.EventData.ImagePath'), '') <> ''"),
    (_rule("r-unknown-operator", [("username", "sounds_like", "x"), ("event_id", "equals", 104)]), "event_id = 104"),
]


def _rule_alert_sql(name: str, where: str, description: str) -> str:
    return (
        f"SELECT 'rule:{name}' AS detector, '{name}' AS rule_name, 'medium' AS severity, {description} AS description, event_ts AS alert_ts, "
        f"'' AS mitre_tactic, 'T0000' AS mitre_technique, 1 AS n FROM sec_events WHERE {where}"
    )


@register(
    "field_rules",
    over_events(
        f"SELECT {VIEW} FROM a",
        "a AS (" + " UNION ALL ".join(_rule_alert_sql(r["name"], w, lit(r["description"])) for r, w in EVENT_RULES) + ")",
    ),
)
def field_rules(spark, sf_dir):
    per_event, _ = split_field_rules([r for r, _ in EVENT_RULES])
    return alert_view(run_row_rules(sec_events(spark, sf_dir), [r.row_rule() for r in per_event]))


GLOBAL_RULE = _rule("r-total", [("event_id", "in", [1102, 104])], threshold=10)
GROUP_RULE = _rule("r-windows", [("event_id", "equals", 4625)], group_by="source_ip", threshold=4, window_seconds=7200)
WHOLE_RULE = _rule("r-whole", [("category", "equals", "process")], group_by="raw.k", threshold=5, window_seconds=0)


def _count_rule_sql(source: str, name: str, description: str, having: str, group: str = "") -> str:
    return (
        f"SELECT 'rule:{name}' AS detector, '{name}' AS rule_name, 'medium' AS severity, '{name} seen: ' || count(*) || {description} AS description, "
        f"strftime(min(event_ts), '%Y-%m-%d %H:%M:%S') AS alert_time, '' AS mitre_tactic, 'T0000' AS mitre_technique, count(*) AS evidence_count "
        f"FROM {source} {group} HAVING {having}"
    )


@register(
    "field_rule_total",
    over_events(_count_rule_sql("(SELECT * FROM sec_events WHERE event_id IN (1102, 104))", "r-total", "' matching event(s)'", "count(*) >= 10")),
)
def field_rule_total(spark, sf_dir):
    return alert_view(field_rule_alerts(sec_events(spark, sf_dir), [FieldRule.of(GLOBAL_RULE)]))


@register(
    "field_rule_windows",
    over_events(
        _count_rule_sql("rw_rows", "r-windows", "' matching event(s) for source_ip=''' || gk || ''''", "count(*) >= 4", "GROUP BY gk, w"),
        "rw AS (SELECT *, source_ip AS gk FROM sec_events WHERE event_id = 4625), " + window_ctes("rw", "rw", 7200, 1),
    ),
)
def field_rule_windows(spark, sf_dir):
    return alert_view(field_rule_alerts(sec_events(spark, sf_dir), [FieldRule.of(GROUP_RULE)]))


@register(
    "field_rule_groups",
    over_events(
        _count_rule_sql(
            "(SELECT *, json_extract_string(raw_json, '$.k') AS gk FROM sec_events WHERE category = 'process')", "r-whole",
            "' matching event(s) for raw.k=''' || gk || ''''", "count(*) >= 5", "GROUP BY gk",
        )
    ),
)
def field_rule_groups(spark, sf_dir):
    return alert_view(field_rule_alerts(sec_events(spark, sf_dir), [FieldRule.of(WHOLE_RULE)]))


def _sigma(title, detection, **more):
    return {"title": title, "detection": detection, "level": "high", "tags": ["attack.defense_evasion", "attack.t1000.001"], **more}


# (rule, SQL of its predicate)
SIGMA_RULES = [
    (_sigma("download", {"selection": {"Image|endswith": "certutil.exe", "CommandLine|contains": ["URLCACHE", "verifyctl"]}, "condition": "selection"},
            logsource={"category": "process_creation"}, level="critical", falsepositives=["CA tooling"]),
     "category = 'process' AND lower(process_name) LIKE '%certutil.exe' AND (contains(lower(command_line), 'urlcache') OR contains(lower(command_line), 'verifyctl'))"),
    (_sigma("not-filter", {"sel": {"EventID": 4624}, "filter1": {"LogonType": [3, 10]}, "filter2": {"User": "SYSTEM"}, "condition": "sel and not (filter1 or filter2)"}),
     "event_id = 4624 AND NOT (logon_type IN (3, 10) OR lower(username) = 'system')"),
    (_sigma("one-of", {"a_1": {"CommandLine|startswith": ["net ", "reg "]}, "a_2": {"CommandLine|re": r"^sc\s+create"}, "b": {"Image": "*.EXE"}, "condition": "1 of a_* and b"}),
     r"(starts_with(lower(command_line), 'net ') OR starts_with(lower(command_line), 'reg ') OR regexp_matches(command_line, '^sc\s+create', 'i')) AND lower(process_name) LIKE '%.exe'"),
    (_sigma("all-of-them", {"x": {"EventID": 4769}, "y": {"TicketEncryptionType": "0x17"}, "z": {"TargetUserName|all": ["web*", "*svc"]}, "condition": "all of them"}),
     "event_id = 4769 AND json_extract_string(raw_json, '$.EventData.TicketEncryptionType') = '0x17' AND lower(target_username) LIKE 'web%' AND lower(target_username) LIKE '%svc'"),
    (_sigma("any-of-contains-all", {"selection": {"CommandLine|contains|all": ["hklm", "netsh"]}}),
     "contains(lower(command_line), 'hklm') OR contains(lower(command_line), 'netsh')"),
    (_sigma("list-form", {"selection": [{"EventID": 4672}, {"EventID": 4673}, {"PrivilegeList|contains": "SeDebug"}], "condition": "selection"}, level="informational"),
     "event_id IN (4672, 4673) AND contains(lower(coalesce(json_extract_string(raw_json, '$.EventData.PrivilegeList'), '')), 'sedebug')"),
    (_sigma("precedence", {"a": {"EventID": 7045}, "b": {"EventID": 1102}, "c": {"Computer": "HOST1"}, "condition": "a or b AND c"}),
     "event_id = 7045 OR (event_id = 1102 AND lower(computer) = 'host1')"),
    (_sigma("never", {"selection": {"EventID": 1}, "condition": "missing"}), "false"),
    (_sigma("run-key", {"selection": {"TargetObject|contains": "\\CurrentVersion\\Run"}, "condition": "selection"}, logsource={"category": "registry_event"}),
     f"category = 'registry' AND contains(lower(json_extract_string(raw_json, '$.EventData.TargetObject')), {BS} || 'currentversion' || {BS} || 'run')"),
]
_LEVEL = {"critical": "critical", "informational": "info"}


@register(
    "sigma_rules",
    over_events(
        f"SELECT {VIEW} FROM a",
        "a AS (" + " UNION ALL ".join(
            f"SELECT 'sigma:{r['title']}' AS detector, 'Sigma: {r['title']}' AS rule_name, '{_LEVEL.get(r['level'], 'high')}' AS severity, "
            f"'{r['title']}' AS description, event_ts AS alert_ts, 'Defense Evasion' AS mitre_tactic, 'T1000.001' AS mitre_technique, 1 AS n "
            f"FROM sec_events WHERE {w}" for r, w in SIGMA_RULES
        ) + ")",
    ),
)
def sigma_rules(spark, sf_dir):
    return alert_view(detect_sigma(sec_events(spark, sf_dir), [r for r, _ in SIGMA_RULES]))


@register(
    "sigma_contains_all_spec",
    over_events("SELECT count(*) AS n FROM sec_events WHERE contains(lower(command_line), 'reg') AND contains(lower(command_line), 'save')"),
)
def sigma_contains_all_spec(spark, sf_dir):
    rule = _sigma("spec", {"selection": {"CommandLine|contains|all": ["reg", "save"]}})
    return detect_sigma(sec_events(spark, sf_dir), [rule], spec_all=True).agg(F.count(F.lit(1)).alias("n"))


# ---- hash chain ------------------------------------------------------------------------

SEGMENT_SIZE = 16
_PAYLOAD = _FINGER.replace("sha256(json_object", "(json_object").replace("{raw}", "'raw', raw_json, ").replace("{tail}", ")")
CHAIN_CTE = (
    "p0 AS (SELECT computer AS chain_id, CAST(event_ts AS DATE) AS day, event_ts, event_uid, " + _PAYLOAD + " AS payload, "
    "('0x' || substr(sha256(event_uid), 1, 8))::BIGINT AS h FROM sec_events), "
    f"p1 AS (SELECT *, h % CAST(ceil(count(*) OVER (PARTITION BY chain_id, day) / {SEGMENT_SIZE}.0) AS BIGINT) AS shard FROM p0), "
    "p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chain_id, day, shard ORDER BY event_ts, event_uid) AS seq FROM p1), "
    "ch AS (SELECT chain_id, day, shard, seq, '' AS previous_hash, sha256(payload) AS event_hash FROM p WHERE seq = 1 UNION ALL "
    "SELECT p.chain_id, p.day, p.shard, p.seq, ch.event_hash, sha256(ch.event_hash || p.payload) FROM ch JOIN p ON p.chain_id = ch.chain_id "
    "AND p.day = ch.day AND p.shard = ch.shard AND p.seq = ch.seq + 1)"
)


@register(
    "chain_append",
    over_events("SELECT chain_id, strftime(day, '%Y-%m-%d') AS day, shard, seq, previous_hash, event_hash FROM ch", CHAIN_CTE),
)
def chain_append(spark, sf_dir):
    return hashchain.append_chain(sec_events(spark, sf_dir), segment_size=SEGMENT_SIZE).select(
        "chain_id", F.col("day").cast("string").alias("day"), "shard", F.col("seq").cast("bigint").alias("seq"), "previous_hash", "event_hash"
    )


@register(
    "chain_heads",
    over_events(
        "SELECT chain_id, strftime(day, '%Y-%m-%d') AS day, shard, max(seq) AS seq, arg_max(event_hash, seq) AS event_hash FROM ch GROUP BY 1, 2, 3", CHAIN_CTE
    ),
)
def chain_heads(spark, sf_dir):
    heads = hashchain.chain_heads(hashchain.append_chain(sec_events(spark, sf_dir), segment_size=SEGMENT_SIZE))
    return heads.select("chain_id", F.col("day").cast("string").alias("day"), "shard", F.col("seq").cast("bigint").alias("seq"), "event_hash")


@register(
    "chain_verify_tampered",
    over_events(
        "SELECT chain_id, strftime(day, '%Y-%m-%d') AS day, shard, seq, true AS hash_mismatch, false AS link_mismatch FROM p WHERE event_uid LIKE '%77'", CHAIN_CTE
    ),
)
def chain_verify_tampered(spark, sf_dir):
    """Changed payloads are found, and only those: their links still fit."""
    records = hashchain.append_chain(sec_events(spark, sf_dir), segment_size=SEGMENT_SIZE)
    changed = F.when(F.col("event_uid").endswith("77"), F.concat("payload_json", F.lit(" "))).otherwise(F.col("payload_json"))
    stored = store.materialize(records.withColumn("payload_json", changed), "chain")
    return hashchain.verify_chain(stored).select(
        "chain_id", F.col("day").cast("string").alias("day"), "shard", F.col("seq").cast("bigint").alias("seq"), "hash_mismatch", "link_mismatch"
    )
