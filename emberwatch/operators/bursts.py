"""Detectors that need several events of one key: bursts, spreads, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.events import dns_query_sql
from emberwatch.functions.sqltext import EVENT_TIME, TARGET_OR_USER, USER_OR_TARGET, first_text, in_list, lit
from emberwatch.functions.text import entropy_sql
from emberwatch.operators.alerts import STAGES as BY_STAGES
from emberwatch.operators.alerts import WHOLE, GroupRule, run_group_rules
from emberwatch.operators.settings import DetectorSettings
from emberwatch.operators.stateless import QUIET, QUIET_ACCOUNTS
from emberwatch.operators.windows import stage_bits

# Privileges worth an alert and accounts that hold them by design.
SENSITIVE_PRIVILEGES = [
    "SeDebugPrivilege", "SeTcbPrivilege", "SeAssignPrimaryTokenPrivilege", "SeLoadDriverPrivilege",
    "SeBackupPrivilege", "SeRestorePrivilege", "SeTakeOwnershipPrivilege", "SeImpersonatePrivilege",
]
PRIVILEGED_ACCOUNTS = ["SYSTEM", "LOCAL SERVICE", "NETWORK SERVICE", "DWM-1", "UMFD-0"]

# Discovery commands and the order of attack stages.
DISCOVERY_TOOLS = [
    "whoami", "ipconfig", "systeminfo", "net", "nltest", "dsquery",
    "hostname", "nslookup", "tasklist", "netstat", "arp", "route",
    "wmic", "query", "cmdkey",
]
STAGES = ["Credential Access", "Privilege Escalation", "Lateral Movement", "Execution"]
CHAIN_EVIDENCE_CAP = 15

LISTED = "array_join(names, ', ')"
TOOL = r"replace(element_at(split(lower(process_name), '\\\\'), -1), '.exe', '')"
QUERY = dns_query_sql("try_parse_json(raw_json)")
LABEL = "substring_index(q, '.', 1)"
PARENT = f"substring_index({QUERY}, '.', 1 - size(split({QUERY}, '[.]')))"
REMOTE = (
    f"event_id IN (4624, 4648) AND logon_type IN (3, 10) AND {TARGET_OR_USER} <> '' "
    f"AND NOT {in_list(TARGET_OR_USER, QUIET_ACCOUNTS)}"  # compared as written, without changing case
)
FAILED = "event_id IN (4625, 4776)"
STAGE = (
    f"CASE WHEN {FAILED} THEN {lit(STAGES[0])} WHEN event_id IN (4672, 4673, 4674) THEN {lit(STAGES[1])} "
    f"WHEN event_id = 4624 AND logon_type IN (3, 10) THEN {lit(STAGES[2])} "
    f"WHEN category = 'process' AND process_name <> '' THEN {lit(STAGES[3])} END"
)


def _text(*parts: str) -> str:
    """SQL concat: every other part is literal text, starting with the first."""
    return "concat(" + ", ".join(lit(p) if i % 2 == 0 else f"cast({p} as string)" for i, p in enumerate(parts)) + ")"


def _bit_names(names: list[str], order: list[str]) -> str:
    """SQL array of the names whose bit is set, in the given order; bit i stands for ``names[i]``."""
    arms = ", ".join(f"CASE WHEN bits & {1 << names.index(n)} <> 0 THEN {lit(n)} END" for n in order)
    return f"array_compact(array({arms}))"


def brute_force(s: DetectorSettings) -> GroupRule:
    base = s.brute_force_threshold
    return GroupRule(
        "brute_force", F.expr(FAILED), first_text("source_ip", "'unknown'"),
        "CASE WHEN n_distinct > 3 THEN 'Password Spray Detected' ELSE 'Brute-Force Detected' END",
        f"CASE WHEN n >= {3 * base} THEN 'critical' WHEN n >= {2 * base} THEN 'high' ELSE 'medium' END",
        _text("", "n", " failed logon attempts from ", "key", " targeting ", "n_distinct",
              f" account(s) within {s.brute_force_window}s"),
        "Credential Access", "T1110 - Brute Force",
        _text("Look into source ", "key", " and reset the accounts it tried: ", LISTED),
        {"timestamp": EVENT_TIME, "source_ip": "source_ip", "username": TARGET_OR_USER, "event_id": "event_id", "computer": "computer"},
        width_seconds=s.brute_force_window, minimum=base, value=TARGET_OR_USER,
    )


def lateral_movement(s: DetectorSettings) -> GroupRule:
    return GroupRule(
        "lateral_movement", F.expr(REMOTE), TARGET_OR_USER, lit("Lateral Movement Detected"),
        "CASE WHEN bits = 1 THEN 'high' ELSE 'medium' END",
        _text("User '", "key", "' authenticated to ", "n_distinct", f" distinct hosts within {s.lateral_window}s: ", LISTED),
        "Lateral Movement", "T1021 - Remote Services",
        _text("Ask whether '", "key", "' had a reason to use these hosts."),
        {"timestamp": EVENT_TIME, "username": TARGET_OR_USER, "computer": "computer", "source_ip": "source_ip", "logon_type": "logon_type"},
        width_seconds=s.lateral_window, value="computer", bits="CASE WHEN logon_type = 10 THEN 1 ELSE 0 END",
        having=f"n_distinct >= {s.lateral_host_threshold}",
    )


def privilege_escalation(s: DetectorSettings) -> GroupRule:
    """One alert per account over the whole input."""
    names = SENSITIVE_PRIVILEGES
    bits = " + ".join(f"CASE WHEN contains(raw_json, {lit(p)}) THEN {1 << i} ELSE 0 END" for i, p in enumerate(names))
    held = ", ".join(f"CASE WHEN contains(raw_json, {lit(p)}) THEN {lit(p)} END" for p in names)
    any_held = " OR ".join(f"contains(raw_json, {lit(p)})" for p in names)
    return GroupRule(
        "privilege_escalation",
        F.expr(f"event_id IN (4672, 4673, 4674) AND {USER_OR_TARGET} <> '' AND NOT {in_list(f'upper({USER_OR_TARGET})', PRIVILEGED_ACCOUNTS)} AND ({any_held})"),
        USER_OR_TARGET, lit("Suspicious Privilege Assignment"),
        f"CASE WHEN bits & {1 << names.index('SeDebugPrivilege')} <> 0 THEN 'high' ELSE 'medium' END",
        _text("User '", "key", "' was assigned sensitive privileges (", "n", " event(s)): ",
              f"array_join({_bit_names(names, sorted(names))}, ', ')"),
        "Privilege Escalation", "T1134 - Access Token Manipulation",
        _text("Ask whether '", "key", "' needs these privileges."),
        {"timestamp": EVENT_TIME, "username": USER_OR_TARGET, "computer": "computer", "event_id": "event_id",
         "privileges": f"array_compact(array({held}))"},
        kind=WHOLE, bits=bits,
    )


def discovery(s: DetectorSettings) -> GroupRule:
    user = first_text("username", "target_username", "'unknown'")
    return GroupRule(
        "discovery", F.expr(in_list(TOOL, DISCOVERY_TOOLS)), user, lit("Reconnaissance Burst Detected"), lit("medium"),
        _text("User '", "key", "' ran ", "n", " recon commands (", LISTED, f") within {s.recon_window}s on ",
              "evidence[0].computer"),
        "Discovery", "T1082 - System Information Discovery",
        _text("Look into '", "key", "': discovery bursts often come early in an attack."),
        {"timestamp": EVENT_TIME, "username": user, "computer": "computer", "process": "process_name",
         "command_line": "substring(command_line, 1, 300)"},
        width_seconds=s.recon_window, minimum=s.recon_threshold, value=TOOL, names_shown=len(DISCOVERY_TOOLS),
    )


def dns_exfiltration(s: DetectorSettings) -> GroupRule:
    return GroupRule(
        "dns_exfiltration",
        # The id test comes first and guards the parse; rows that fail it are never parsed.
        F.expr(
            f"CASE WHEN event_id IN (22, 5353) THEN exists(array({QUERY}), q -> contains(q, '.') "
            f"AND length(substring_index(q, '.', 1)) >= {s.dns_min_label_length} "
            f"AND {entropy_sql(LABEL)} >= {s.dns_min_entropy_bits}) ELSE false END"
        ),
        first_text("computer", "'unknown'"), lit("DNS Exfiltration Burst"),
        f"CASE WHEN n >= {3 * s.dns_query_threshold} THEN 'critical' ELSE 'high' END",
        _text("", "n", " high-entropy DNS queries from ", "key", f" in {s.dns_window_seconds}s spanning ", "n_distinct",
              " parent domain(s): ", LISTED),
        "Exfiltration", "T1048.003 - Exfiltration Over Unencrypted Non-C2 Protocol",
        _text("Check outbound DNS of ", "key", " and block the parent domains."),
        {"timestamp": EVENT_TIME, "computer": "computer", "username": "username", "query": f"substring({QUERY}, 1, 200)",
         "event_id": "event_id"},
        width_seconds=s.dns_window_seconds, minimum=s.dns_query_threshold, value=PARENT, names_shown=3,
    )


def attack_chain(s: DetectorSettings) -> GroupRule:
    seen, span = _bit_names(STAGES, STAGES), "last_ts - first_ts"
    # Half-even rounding, as a fixed-point number formatter does it.
    seconds = (
        f"cast(bround(extract(SECOND FROM {span}) + extract(MINUTE FROM {span}) * 60 + extract(HOUR FROM {span}) * 3600 "
        f"+ extract(DAY FROM {span}) * 86400, 0) as bigint)"
    )
    return GroupRule(
        "attack_chain", F.expr(f"{STAGE} IS NOT NULL AND NOT {QUIET}"), TARGET_OR_USER, lit("Attack Chain Detected"),
        "CASE WHEN bit_count(bits) >= 3 THEN 'critical' ELSE 'high' END",
        _text("User '", "key", "' observed in ", "bit_count(bits)", " attack stages within ", seconds, "s: ",
              f"array_join({seen}, ' -> ')"),
        "Multiple", "Multi-stage Kill Chain",
        _text("Look into '", "key", "' at once: ", "bit_count(bits)", " attack stages lie close together."),
        {"timestamp": EVENT_TIME, "stage": STAGE, "event_id": "event_id", "computer": "computer",
         "username": TARGET_OR_USER, "process": "process_name", "source_ip": "source_ip"},
        kind=BY_STAGES, width_seconds=s.chain_window, minimum=s.chain_min_stages, bits=stage_bits(STAGE, STAGES),
        stages=len(STAGES), evidence_cap=CHAIN_EVIDENCE_CAP,
    )


KEYED_DETECTORS = {
    "brute_force": brute_force,
    "lateral_movement": lateral_movement,
    "privilege_escalation": privilege_escalation,
    "discovery": discovery,
    "dns_exfiltration": dns_exfiltration,
    "attack_chain": attack_chain,
}


def target_or_user() -> Column:
    return F.expr(TARGET_OR_USER)


def detect(events: DataFrame, detector: str, settings: DetectorSettings | None = None) -> DataFrame:
    """Alerts of one keyed detector."""
    return run_group_rules(events, [KEYED_DETECTORS[detector](settings or DetectorSettings())])
