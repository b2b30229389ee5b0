"""SQL statements of what each detector should find, for the oracle engine.

Every detector is a SELECT with the same columns: detector, rule_name, severity,
description, alert_ts, mitre_tactic, mitre_technique, n, and the host, user and ip that
its shown evidence leads to.
"""

from __future__ import annotations

from emberwatch.operators.bursts import DISCOVERY_TOOLS, SENSITIVE_PRIVILEGES, STAGES
from emberwatch.operators.settings import DetectorSettings
from emberwatch.operators.stateless import (
    ARCHIVE_PATTERNS, FIREWALL_COMMANDS, RUN_KEYS, STAGING_PATTERNS, SUSPICIOUS_COMMANDS, SUSPICIOUS_PROGRAMS,
)
from emberwatch.workload.tables import SEC_EVENTS_CTE

# Thresholds the registered queries use: wide enough to fire on the driver's sparse events.
SETTINGS = DetectorSettings(
    brute_force_window=21600, lateral_window=14400, recon_window=7200,
    dns_query_threshold=3, dns_window_seconds=43200, replication_guids=("guid-replication-1",),
)
BS = "chr(92)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {lit(pattern)}, 'i')"


def has(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(w)})" for w in words) + ")"


def in_list(column: str, values) -> str:
    return f"{column} IN ({', '.join(lit(v) if isinstance(v, str) else str(v) for v in values)})"


TU = "(CASE WHEN target_username <> '' THEN target_username ELSE username END)"
UT = "(CASE WHEN username <> '' THEN username ELSE target_username END)"
WHO = "(CASE WHEN username = '' THEN 'unknown' ELSE username END)"
TIME = "strftime(event_ts, '%Y-%m-%d %H:%M:%S')"
LEAF = f"regexp_extract(lower(process_name), '[^{chr(92)}{chr(92)}]*$')"
TOOL = f"replace({LEAF}, '.exe', '')"
PARENT = "substr(query, strpos(query, '.') + 1)"
LABEL = "split_part(query, '.', 1)"
QUERY = "coalesce(nullif(json_extract_string(raw_json, '$.QueryName'), ''), json_extract_string(raw_json, '$.EventData.QueryName'), '')"
ENTROPY = (
    f"(list_sum(list_transform(list_distinct(string_split({LABEL}, '')), lambda c: "
    f"-((length({LABEL}) - length(replace({LABEL}, c, '')))::DOUBLE / length({LABEL})) * "
    f"log2((length({LABEL}) - length(replace({LABEL}, c, '')))::DOUBLE / length({LABEL})))))"
)
OCTETS = [f"CAST(split_part(source_ip, '.', {i}) AS INT)" for i in (1, 2, 3)]
PRIVATE = (
    f"({OCTETS[0]} IN (0, 10, 127) OR {OCTETS[0]} >= 240 OR ({OCTETS[0]} = 169 AND {OCTETS[1]} = 254) "
    f"OR ({OCTETS[0]} = 172 AND {OCTETS[1]} BETWEEN 16 AND 31) OR ({OCTETS[0]} = 192 AND {OCTETS[1]} = 168) "
    f"OR ({OCTETS[0]} = 198 AND ({OCTETS[1]} IN (18, 19) OR ({OCTETS[1]} = 51 AND {OCTETS[2]} = 100))) "
    f"OR ({OCTETS[0]} = 203 AND {OCTETS[1]} = 0 AND {OCTETS[2]} = 113) "
    f"OR ({OCTETS[0]} = 192 AND {OCTETS[1]} = 0 AND {OCTETS[2]} IN (0, 2)))"
)


def _row(detector, rule, severity, description, tactic, technique, where, host="computer", user="username", ip="''"):
    def text(x):
        return x if x.startswith("CASE") or x.startswith("(") else lit(x)

    return (
        f"SELECT {lit(detector)} AS detector, {text(rule)} AS rule_name, {text(severity)} AS severity, "
        f"{description} AS description, event_ts AS alert_ts, {text(tactic)} AS mitre_tactic, "
        f"{text(technique)} AS mitre_technique, 1 AS n, {host} AS host, {user} AS \"user\", {ip} AS ip, [{ip}] AS ips "
        f"FROM sec_events WHERE {where}"
    )


def _where(verb: str) -> str:
    return f"'{verb} on ' || computer || ' by ' || {WHO}"


def _pattern_case(label: int) -> str:
    arms = " ".join(f"WHEN {matches('command_line', row[0])} THEN {lit(row[label])}" for row in SUSPICIOUS_COMMANDS)
    return f"(CASE {arms} END)"


_ARCHIVED = "(" + " OR ".join(matches("command_line", p) for p in ARCHIVE_PATTERNS) + ")"
_STAGED = "(" + " OR ".join(matches("command_line", p) for p in STAGING_PATTERNS) + ")"
_STARTUP = (
    f"(contains(lower(raw_json), {BS} || 'startup' || {BS}) OR contains(lower(command_line), {BS} || 'startup' || {BS}))"
)
_SUCCESS = f"event_id = 4624 AND {TU} <> '' AND upper({TU}) NOT IN ('SYSTEM', 'ANONYMOUS LOGON', '-')"
_CUT = "substr(command_line, 1, 200)"
_RUN = "T1547.001 - Registry Run Keys / Startup Folder"

# Rule name to statement; the suspicious-process statement covers all its rule names.
ROW_SQL = {
    "suspicious_process": _row(
        "suspicious_process", f"('Suspicious Process: ' || {_pattern_case(2)})", _pattern_case(1),
        f"'Process ''' || {LEAF} || ''' executed with suspicious command line on ' || computer || ' by ' || username",
        _pattern_case(3), _pattern_case(4),
        f"category = 'process' AND process_name <> '' AND command_line <> '' AND {in_list(LEAF, SUSPICIOUS_PROGRAMS)} "
        f"AND {_pattern_case(1)} IS NOT NULL",
    ),
    "log_cleared": _row(
        "defense_evasion", "Log Clearing Detected", "high",
        f"'Event log cleared (Event ID ' || event_id || ') on ' || computer || ' by ' || {WHO}",
        "Defense Evasion", "T1070.001 - Clear Windows Event Logs", "event_id IN (1102, 104)",
    ),
    "protection_disabled": _row(
        "defense_evasion", "Windows Defender Disabled", "high", _where("Windows Defender was disabled"),
        "Defense Evasion", "T1562.001 - Disable or Modify Tools", "event_id = 5001",
    ),
    "audit_policy_changed": _row(
        "defense_evasion", "Audit Policy Modified", "medium",
        f"'Audit policy changed (Event ID ' || event_id || ') on ' || computer || ' by ' || {WHO}",
        "Defense Evasion", "T1562.002 - Disable Windows Event Logging", "event_id = 4719",
    ),
    "firewall_change": _row(
        "defense_evasion", "Firewall Rule Modification", "medium",
        _where("Firewall rule modified") + f" || ': ' || {_CUT}",
        "Defense Evasion", "T1562.004 - Disable or Modify System Firewall", has("lower(command_line)", FIREWALL_COMMANDS),
    ),
    "new_service": _row(
        "persistence", "New Service Created",
        "CASE WHEN contains(lower(raw_json), 'powershell') OR contains(lower(raw_json), 'cmd') THEN 'critical' ELSE 'high' END",
        _where("New service installed"), "Persistence", "T1543.003 - Windows Service", "event_id = 7045",
    ),
    "scheduled_task": _row(
        "persistence", "Scheduled Task Created", "high", _where("Scheduled task created"),
        "Persistence", "T1053.005 - Scheduled Task", "event_id = 4698",
    ),
    "run_key": _row(
        "persistence", "Registry Run Key Modified", "high", _where("Registry Run/RunOnce key modified"),
        "Persistence", _RUN, f"event_id = 13 AND {has('lower(raw_json)', RUN_KEYS)}",
    ),
    "startup_folder": _row(
        "persistence", "Startup Folder Modified", "medium", _where("Startup folder modification detected"),
        "Persistence", _RUN, f"event_id <> 13 AND {_STARTUP}",
    ),
    "archive": _row(
        "exfiltration", "Suspicious Archive Creation", "high",
        _where("Archive tool used targeting sensitive paths") + f" || ': ' || {_CUT}",
        "Exfiltration", "T1560.001 - Archive via Utility", f"command_line <> '' AND {_ARCHIVED}",
    ),
    "staging": _row(
        "exfiltration", "Data Staging Detected", "medium", _where("File staging activity") + f" || ': ' || {_CUT}",
        "Exfiltration", "T1074 - Data Staged", f"command_line <> '' AND {_STAGED} AND NOT {_ARCHIVED}",
    ),
    "kerberoasting": _row(
        "kerberos_attacks", "Potential Kerberoasting", "high",
        f"'TGS request with RC4 encryption for non-machine account ''' || {TU} || ''' on ' || computer",
        "Credential Access", "T1558.003 - Kerberoasting",
        f"event_id = 4769 AND contains(lower(raw_json), '0x17') AND {TU} <> '' AND right({TU}, 1) <> '$'",
    ),
    "asrep_roasting": _row(
        "kerberos_attacks", "Potential AS-REP Roasting", "high",
        f"'TGT request with RC4 encryption for account ''' || {TU} || ''' on ' || computer",
        "Credential Access", "T1558.004 - AS-REP Roasting", "event_id = 4768 AND contains(lower(raw_json), '0x17')",
    ),
    "lsass_access": _row(
        "credential_access", "LSASS Memory Access", "critical", _where("LSASS process opened"),
        "Credential Access", "T1003.001 - LSASS Memory",
        "event_id = 10 AND lower(json_extract_string(raw_json, '$.EventData.TargetImage')) LIKE '%lsass.exe'",
    ),
    "sam_access": _row(
        "credential_access", "SAM Hive Access", "critical", _where("SAM registry hive read"),
        "Credential Access", "T1003.002 - Security Account Manager",
        f"event_id = 4663 AND contains(lower(json_extract_string(raw_json, '$.EventData.ObjectName')), {BS} || 'sam')",
    ),
    "directory_replication": _row(
        "credential_access", "Directory Replication Request", "critical", _where("Directory replication requested"),
        "Credential Access", "T1003.006 - DCSync", "event_id = 4662 AND contains(lower(raw_json), 'guid-replication-1')",
    ),
    "external_rdp": _row(
        "initial_access", "External RDP Logon", "high",
        f"'Remote interactive logon from external IP ' || source_ip || ' to ' || computer || ' as ''' || {TU} || ''''",
        "Initial Access", "T1078 - Valid Accounts",
        f"{_SUCCESS} AND logon_type = 10 AND source_ip <> '' AND NOT {PRIVATE}", user=TU, ip="source_ip",
    ),
    "after_hours": _row(
        "initial_access", "After-Hours Logon", "low",
        f"'Logon outside business hours (6:00-20:00) by ''' || {TU} || ''' at ' || {TIME} || ' on ' || computer",
        "Initial Access", "T1078 - Valid Accounts",
        f"{_SUCCESS} AND (hour(event_ts) < 6 OR hour(event_ts) >= 20)", user=TU, ip="source_ip",
    ),
}


def window_ctes(name: str, source: str, width: int, minimum: int) -> str:
    """CTEs that assign rows of ``source`` (gk, event_ts, ...) to greedy windows: ``<name>_rows`` with ``w``."""
    w = f"INTERVAL {width} SECOND"
    return (
        f"{name}_c AS (SELECT *, count(*) OVER (PARTITION BY gk ORDER BY event_ts "
        f"RANGE BETWEEN CURRENT ROW AND {w} FOLLOWING) AS dense FROM {source}), "
        f"{name}_s AS (SELECT DISTINCT gk, event_ts AS t FROM {name}_c WHERE dense >= {minimum}), "
        f"{name}_w AS (SELECT gk, min(t) AS w FROM {name}_s GROUP BY gk UNION ALL "
        f"SELECT a.gk, min(s.t) FROM {name}_w a JOIN {name}_s s ON s.gk = a.gk AND s.t > a.w + {w} GROUP BY a.gk, a.w), "
        f"{name}_rows AS (SELECT r.*, a.w FROM {source} r JOIN {name}_w a ON a.gk = r.gk "
        f"AND r.event_ts BETWEEN a.w AND a.w + {w})"
    )


def _first(column: str, cap: int = 10) -> str:
    """First non-empty value over the shown evidence rows."""
    return f"coalesce(list_filter((list({column} ORDER BY event_ts, event_uid))[1:{cap}], lambda x: x <> '')[1], '')"


def _smallest(column: str, n: int) -> str:
    return f"array_to_string((list_sort(list(DISTINCT {column})))[1:{n}], ', ')"


def keyed_sql(s: DetectorSettings) -> dict[str, tuple[str, str]]:
    """Detector name to (CTEs, SELECT)."""
    stage = (
        f"CASE WHEN event_id IN (4625, 4776) THEN 0 WHEN event_id IN (4672, 4673, 4674) THEN 1 "
        f"WHEN event_id = 4624 AND logon_type IN (3, 10) THEN 2 WHEN category = 'process' AND process_name <> '' THEN 3 END"
    )
    held = {p: f"bool_or(contains(raw_json, '{p}'))" for p in SENSITIVE_PRIVILEGES}
    held_list = " || ".join(f"CASE WHEN {held[p]} THEN ', {p}' ELSE '' END" for p in sorted(held))
    any_held = has("raw_json", SENSITIVE_PRIVILEGES)
    chain_w = f"INTERVAL {s.chain_window} SECOND"
    later = (
        "OVER (PARTITION BY gk ORDER BY event_ts RANGE BETWEEN CURRENT ROW AND " + chain_w + " FOLLOWING)"
    )
    stages = " || ".join(
        f"CASE WHEN bool_or(stage = {i}) THEN ' -> {name}' ELSE '' END" for i, name in enumerate(STAGES)
    )
    n_stages = "count(DISTINCT stage)"
    out = {
        "brute_force": (
            f"bf AS (SELECT *, CASE WHEN source_ip = '' THEN 'unknown' ELSE source_ip END AS gk, {TU} AS target "
            f"FROM sec_events WHERE event_id IN (4625, 4776)), " + window_ctes("bf", "bf", s.brute_force_window, s.brute_force_threshold),
            f"SELECT 'brute_force' AS detector, CASE WHEN count(DISTINCT target) > 3 THEN 'Password Spray' ELSE 'Brute-Force' END "
            f"|| ' Detected' AS rule_name, CASE WHEN count(*) >= {3 * s.brute_force_threshold} THEN 'critical' "
            f"WHEN count(*) >= {2 * s.brute_force_threshold} THEN 'high' ELSE 'medium' END AS severity, "
            f"count(*) || ' failed logon attempts from ' || gk || ' targeting ' || count(DISTINCT target) || "
            f"' account(s) within {s.brute_force_window}s' AS description, min(event_ts) AS alert_ts, "
            f"'Credential Access' AS mitre_tactic, 'T1110 - Brute Force' AS mitre_technique, count(*) AS n, "
            f"{_first('computer')} AS host, {_first('target')} AS \"user\", {_first('source_ip')} AS ip, list(DISTINCT source_ip) AS ips "
            f"FROM bf_rows GROUP BY gk, w",
        ),
        "lateral_movement": (
            f"lm AS (SELECT *, {TU} AS gk FROM sec_events WHERE event_id IN (4624, 4648) AND logon_type IN (3, 10) "
            f"AND {TU} NOT IN ('SYSTEM', 'ANONYMOUS LOGON', '-', '')), " + window_ctes("lm", "lm", s.lateral_window, 1),
            f"SELECT 'lateral_movement' AS detector, 'Lateral Movement Detected' AS rule_name, "
            f"CASE WHEN bool_or(logon_type = 10) THEN 'high' ELSE 'medium' END AS severity, "
            f"'User ''' || gk || ''' authenticated to ' || count(DISTINCT computer) || ' distinct hosts within {s.lateral_window}s: ' "
            f"|| {_smallest('computer', 5)} AS description, min(event_ts) AS alert_ts, 'Lateral Movement' AS mitre_tactic, "
            f"'T1021 - Remote Services' AS mitre_technique, count(*) AS n, {_first('computer')} AS host, gk AS \"user\", "
            f"{_first('source_ip')} AS ip, list(DISTINCT source_ip) AS ips FROM lm_rows GROUP BY gk, w HAVING count(DISTINCT computer) >= {s.lateral_host_threshold}",
        ),
        "privilege_escalation": (
            f"pv AS (SELECT *, {UT} AS gk FROM sec_events WHERE event_id IN (4672, 4673, 4674) AND {UT} <> '' "
            f"AND upper({UT}) NOT IN ('SYSTEM', 'LOCAL SERVICE', 'NETWORK SERVICE', 'DWM-1', 'UMFD-0') AND {any_held})",
            f"SELECT 'privilege_escalation' AS detector, 'Suspicious Privilege Assignment' AS rule_name, "
            f"CASE WHEN {held['SeDebugPrivilege']} THEN 'high' ELSE 'medium' END AS severity, "
            f"'User ''' || gk || ''' was assigned sensitive privileges (' || count(*) || ' event(s)): ' || substr({held_list}, 3) "
            f"AS description, min(event_ts) AS alert_ts, 'Privilege Escalation' AS mitre_tactic, "
            f"'T1134 - Access Token Manipulation' AS mitre_technique, count(*) AS n, {_first('computer')} AS host, "
            f"gk AS \"user\", '' AS ip, [''] AS ips FROM pv GROUP BY gk",
        ),
        "discovery": (
            f"dc AS (SELECT *, CASE WHEN {UT} = '' THEN 'unknown' ELSE {UT} END AS gk, {TOOL} AS tool FROM sec_events "
            f"WHERE {in_list(TOOL, DISCOVERY_TOOLS)}), " + window_ctes("dc", "dc", s.recon_window, s.recon_threshold),
            f"SELECT 'discovery' AS detector, 'Reconnaissance Burst Detected' AS rule_name, 'medium' AS severity, "
            f"'User ''' || gk || ''' ran ' || count(*) || ' recon commands (' || {_smallest('tool', 99)} || ') within "
            f"{s.recon_window}s on ' || (list(computer ORDER BY event_ts, event_uid))[1] AS description, "
            f"min(event_ts) AS alert_ts, 'Discovery' AS mitre_tactic, 'T1082 - System Information Discovery' AS mitre_technique, "
            f"count(*) AS n, {_first('computer')} AS host, gk AS \"user\", '' AS ip, [''] AS ips FROM dc_rows GROUP BY gk, w",
        ),
        "dns_exfiltration": (
            f"dn0 AS (SELECT *, {QUERY} AS query FROM sec_events WHERE event_id IN (22, 5353)), "
            f"dn AS (SELECT *, CASE WHEN computer = '' THEN 'unknown' ELSE computer END AS gk FROM dn0 WHERE contains(query, '.') "
            f"AND length({LABEL}) >= {s.dns_min_label_length} AND {ENTROPY} >= {s.dns_min_entropy_bits}), "
            + window_ctes("dn", "dn", s.dns_window_seconds, s.dns_query_threshold),
            f"SELECT 'dns_exfiltration' AS detector, 'DNS Exfiltration Burst' AS rule_name, "
            f"CASE WHEN count(*) >= {3 * s.dns_query_threshold} THEN 'critical' ELSE 'high' END AS severity, "
            f"count(*) || ' high-entropy DNS queries from ' || gk || ' in {s.dns_window_seconds}s spanning ' || "
            f"count(DISTINCT substr(query, strpos(query, '.') + 1)) || ' parent domain(s): ' || "
            f"{_smallest(PARENT, 3)} AS description, "
            f"min(event_ts) AS alert_ts, 'Exfiltration' AS mitre_tactic, "
            f"'T1048.003 - Exfiltration Over Unencrypted Non-C2 Protocol' AS mitre_technique, count(*) AS n, "
            f"{_first('computer')} AS host, {_first('username')} AS \"user\", '' AS ip, [''] AS ips FROM dn_rows GROUP BY gk, w",
        ),
        "attack_chain": (
            f"ac0 AS (SELECT *, {TU} AS gk, {stage} AS stage FROM sec_events), "
            f"ac AS (SELECT * FROM ac0 WHERE stage IS NOT NULL AND gk <> '' AND upper(gk) NOT IN ('SYSTEM', 'ANONYMOUS LOGON', '-')), "
            f"ac_n AS (SELECT gk, event_ts AS t, " + " + ".join(f"CAST(max(CASE WHEN stage = {i} THEN 1 ELSE 0 END) {later} AS INT)" for i in range(4))
            + f" AS hit FROM ac), ac_w AS (SELECT gk, min(t) AS w FROM ac_n WHERE hit >= {s.chain_min_stages} GROUP BY gk), "
            f"ac_rows AS (SELECT r.*, a.w FROM ac r JOIN ac_w a ON a.gk = r.gk AND r.event_ts BETWEEN a.w AND a.w + {chain_w})",
            f"SELECT 'attack_chain' AS detector, 'Attack Chain Detected' AS rule_name, "
            f"CASE WHEN {n_stages} >= 3 THEN 'critical' ELSE 'high' END AS severity, 'User ''' || gk || ''' observed in ' || {n_stages} "
            f"|| ' attack stages within ' || CAST(round_even(epoch_us(max(event_ts)) / 1000000.0 - epoch_us(min(event_ts)) / 1000000.0, 0) AS BIGINT) "
            f"|| 's: ' || substr({stages}, 5) AS description, min(event_ts) AS alert_ts, 'Multiple' AS mitre_tactic, "
            f"'Multi-stage Kill Chain' AS mitre_technique, count(*) AS n, {_first('computer', 15)} AS host, gk AS \"user\", "
            f"{_first('source_ip', 15)} AS ip, list(DISTINCT source_ip) AS ips FROM ac_rows GROUP BY gk, w",
        ),
    }
    return out


KEYED_SQL = keyed_sql(SETTINGS)

VIEW = (
    "detector, rule_name, severity, description, strftime(alert_ts, '%Y-%m-%d %H:%M:%S') AS alert_time, "
    "mitre_tactic, mitre_technique, CAST(n AS BIGINT) AS evidence_count"
)


def row_oracle(name: str) -> str:
    return f"WITH {SEC_EVENTS_CTE}, a AS ({ROW_SQL[name]}) SELECT {VIEW} FROM a"


def keyed_oracle(name: str) -> str:
    ctes, select = KEYED_SQL[name]
    return f"WITH RECURSIVE {SEC_EVENTS_CTE}, {ctes}, a AS ({select}) SELECT {VIEW} FROM a"


def _all_alerts() -> str:
    ctes = ", ".join(c for c, _ in KEYED_SQL.values())
    selects = " UNION ALL ".join([*ROW_SQL.values(), *[s for _, s in KEYED_SQL.values()]])
    return f"{SEC_EVENTS_CTE}, {ctes}, alerts0 AS ({selects})"


# CTEs ``alerts`` (all detectors) with the alert id; follow "WITH RECURSIVE".
ISO = (
    "CASE WHEN microsecond(alert_ts) % 1000000 = 0 THEN strftime(alert_ts, '%Y-%m-%dT%H:%M:%S') "
    "ELSE strftime(alert_ts, '%Y-%m-%dT%H:%M:%S.%f') END"
)
RANK = "(CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END)"
ALERTS_CTE = (
    _all_alerts() + f", alerts AS MATERIALIZED (SELECT *, {RANK} AS severity_rank, {ISO} AS iso, "
    f"sha256(rule_name || {ISO} || description) AS alert_id FROM alerts0)"
)
