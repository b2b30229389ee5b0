"""Single-event detectors, as rules for the fused pass of :mod:`rowrules`."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberwatch.functions.events import json_path
from emberwatch.functions.network import is_private_ip
from emberwatch.functions.sqltext import (
    EVENT_TIME, TARGET_OR_USER, any_search, contains_any, first_match, in_list, lit, search,
)
from emberwatch.operators.rowrules import RowRule
from emberwatch.operators.settings import DetectorSettings

# Accounts whose logons are not reported (compared in upper case).
QUIET_ACCOUNTS = ["SYSTEM", "ANONYMOUS LOGON", "-"]

# Programs whose command lines are checked.
SUSPICIOUS_PROGRAMS = [
    "powershell.exe", "pwsh.exe", "cmd.exe", "wscript.exe", "cscript.exe",
    "mshta.exe", "regsvr32.exe", "rundll32.exe", "certutil.exe",
    "bitsadmin.exe", "msiexec.exe", "wmic.exe", "psexec.exe",
    "net.exe", "net1.exe", "schtasks.exe", "at.exe",
    "reg.exe", "sc.exe",
]

# Ordered command-line patterns with severity, label, tactic and technique.
# The first pattern that matches decides.
SUSPICIOUS_COMMANDS = [
    (r"\b(?:nc|ncat|netcat)\b.*(?:-e|--exec|/bin/sh|cmd\.exe)", "high",
     "Netcat-style reverse shell", "Command and Control", "T1059 - Command and Scripting Interpreter"),
    (r"bash\s+-i\s*>&\s*/dev/tcp/\S+/\d+\s+0>&1", "high",
     "Bash reverse shell", "Command and Control", "T1059 - Command and Scripting Interpreter"),
    (r"powershell.*(?:tcpclient|networkstream|getstream|write\(\[text\.encoding\]::ascii\.getbytes|iex\s+\$)", "high",
     "PowerShell reverse shell behavior", "Command and Control", "T1059.001 - PowerShell"),
    (r"python\s+-c\s+.*(?:socket|subprocess|pty).*", "high",
     "Python-based reverse shell", "Command and Control", "T1059 - Command and Scripting Interpreter"),
    (r"perl\s+-e\s+.*(?:socket|exec|fork).*", "high",
     "Perl-based reverse shell", "Command and Control", "T1059 - Command and Scripting Interpreter"),
    (r"socat\s+.*exec:.*", "high",
     "Socat reverse shell", "Command and Control", "T1059 - Command and Scripting Interpreter"),
    (r"-enc(odedcommand)?\s+[A-Za-z0-9+/=]{20,}", "high",
     "Base64-encoded PowerShell command", "Execution", "T1059.001 - PowerShell"),
    (r"Invoke-(WebRequest|RestMethod|Expression)", "high",
     "PowerShell download/exec cradle", "Execution", "T1059.001 - PowerShell"),
    (r"IEX\s*\(", "high",
     "PowerShell Invoke-Expression", "Execution", "T1059.001 - PowerShell"),
    (r"(New-Object\s+Net\.WebClient|DownloadString|DownloadFile)", "high",
     "Network download via PowerShell", "Command and Control", "T1105 - Ingress Tool Transfer"),
    (r"bypass\s+.*executionpolicy", "medium",
     "Execution policy bypass", "Defense Evasion", "T1562.001 - Disable or Modify Tools"),
    (r"-nop(rofile)?\s+-w(indowstyle)?\s+hidden", "high",
     "Hidden PowerShell window", "Defense Evasion", "T1564.003 - Hidden Window"),
    (r"certutil.*-urlcache.*-split.*-f", "high",
     "Certutil used as download cradle", "Command and Control", "T1105 - Ingress Tool Transfer"),
    (r"reg\s+(add|save|export).*\\sam", "critical",
     "SAM registry hive access", "Credential Access", "T1003.002 - Security Account Manager"),
    (r"sekurlsa|mimikatz|kerberos::list", "critical",
     "Credential dumping tool keyword", "Credential Access", "T1003.001 - LSASS Memory"),
    (r"whoami\s+/priv", "low",
     "Privilege enumeration", "Discovery", "T1033 - System Owner/User Discovery"),
    (r"net\s+user\s+\S+\s+\S+.*/(add|domain)", "high",
     "Account creation or password change", "Persistence", "T1136.001 - Local Account"),
    (r"net\s+(user|localgroup|group)\s+", "low",
     "Account/group enumeration", "Discovery", "T1087 - Account Discovery"),
    (r"schtasks\s+/create\s+", "high",
     "Scheduled task creation (persistence)", "Persistence", "T1053.005 - Scheduled Task"),
    (r"sc\s+(create|config)\s+", "high",
     "Service creation/modification", "Persistence", "T1543.003 - Windows Service"),
]

# Firewall commands, run-key paths (as JSON text shows them, with doubled
# backslashes), startup folder, archive and staging patterns, weak ticket encryption.
FIREWALL_COMMANDS = [
    "netsh advfirewall", "set-netfirewallprofile", "disable-netfirewallrule",
    "new-netfirewallrule", "remove-netfirewallrule",
]
RUN_KEYS = [
    r"\\software\\microsoft\\windows\\currentversion\\run",
    r"\\software\\microsoft\\windows\\currentversion\\runonce",
    r"\\software\\wow6432node\\microsoft\\windows\\currentversion\\run",
    r"\\software\\wow6432node\\microsoft\\windows\\currentversion\\runonce",
]
STARTUP_FOLDERS = ["\\startup\\", "\\start menu\\programs\\startup\\"]
ARCHIVE_PATTERNS = [
    r"\b(rar|7z|zip)\b.*\b(c:\\users|c:\\windows|\\\\|/home|/etc|/var)",
    r"\b(compress-archive|tar\s+[cz])\b",
]
STAGING_PATTERNS = [
    r"\b(compress|archive|zip|rar|7z)\b.*\b(c:\\|d:\\|/tmp|/var)",
    r"\b(copy|xcopy|robocopy|cp|rsync)\b.*\b(\\\\|smb://)",
]
WEAK_ENCRYPTION = "0x17"


QUIET = f"({TARGET_OR_USER} = '' OR {in_list(f'upper({TARGET_OR_USER})', QUIET_ACCOUNTS)})"
PROGRAM = r"element_at(split(lower(process_name), '\\\\'), -1)"
WHO = "CASE WHEN username = '' THEN 'unknown' ELSE username END"

# Evidence of the rules as SQL expressions.
AT = {"timestamp": EVENT_TIME, "event_id": "event_id", "computer": "computer"}
BASIC = {**AT, "username": "username"}
WITH_COMMAND = {**BASIC, "command_line": "substring(command_line, 1, 500)"}
WITH_PROCESS = {**BASIC, "process": "process_name"}
LOGON = {**AT, "username": TARGET_OR_USER, "source_ip": "source_ip", "logon_type": "logon_type"}
TICKET = {**BASIC, "target_username": TARGET_OR_USER, "encryption_type": lit(WEAK_ENCRYPTION)}


def _where(verb: str, with_id: bool = False, with_command: bool = False) -> Column:
    """``<verb> on <host> by <user>``, optionally with the event id or the start of the command."""
    head = f"concat({lit(verb + ' (Event ID ')}, event_id, ')')" if with_id else lit(verb)
    tail = ", ': ', substring(command_line, 1, 200)" if with_command else ""
    return F.expr(f"concat({head}, ' on ', computer, ' by ', {WHO}{tail})")


def suspicious_process(s: DetectorSettings) -> list[RowRule]:
    # Number of the first pattern that matches, NULL for none and for programs not checked.
    number = first_match(
        [(search("command_line", row[0]), str(i + 1)) for i, row in enumerate(SUSPICIOUS_COMMANDS)], "null"
    )
    checked = f"category = 'process' AND process_name <> '' AND command_line <> '' AND {in_list(PROGRAM, SUSPICIOUS_PROGRAMS)}"

    def label(i: int) -> str:
        return f"element_at(array({', '.join(lit(row[i]) for row in SUSPICIOUS_COMMANDS)}), command_pattern)"

    return [
        RowRule(
            "suspicious_process", F.expr("command_pattern IS NOT NULL"),
            F.expr(f"concat('Suspicious Process: ', {label(2)})"), F.expr(label(1)),
            F.expr(
                f"concat({lit("Process " + chr(39))}, {PROGRAM}, "
                f"{lit(chr(39) + ' executed with suspicious command line on ')}, computer, ' by ', username)"
            ),
            F.expr(label(3)), F.expr(label(4)),
            "Read the whole command line and its parent process and decide whether it was authorized.",
            {
                "timestamp": EVENT_TIME, "process": "process_name", "command_line": "substring(command_line, 1, 500)",
                "parent_process": "parent_process", "username": "username", "computer": "computer",
            },
            {"command_pattern": F.expr(f"CASE WHEN {checked} THEN {number} END")},
        )
    ]


# Fixed values, here and below: rule names, labels and the beginnings of descriptions, which are part of an alert's key.


def defense_evasion(s: DetectorSettings) -> list[RowRule]:
    tactic = "Defense Evasion"
    return [
        RowRule(
            "defense_evasion", F.expr("event_id IN (1102, 104)"), "Log Clearing Detected", "high",
            _where("Event log cleared", with_id=True), tactic, "T1070.001 - Clear Windows Event Logs",
            "Find out who cleared the log and compare with forwarded copies.", BASIC,
        ),
        RowRule(
            "defense_evasion", F.expr("event_id = 5001"), "Windows Defender Disabled", "high",
            _where("Windows Defender was disabled"), tactic, "T1562.001 - Disable or Modify Tools",
            "Confirm the change was planned and turn protection back on.", BASIC,
        ),
        RowRule(
            "defense_evasion", F.expr("event_id = 4719"), "Audit Policy Modified", "medium",
            _where("Audit policy changed", with_id=True), tactic, "T1562.002 - Disable Windows Event Logging",
            "Confirm the policy change was planned.", BASIC,
        ),
        RowRule(
            "defense_evasion", F.expr(contains_any("lower(command_line)", FIREWALL_COMMANDS)),
            "Firewall Rule Modification", "medium", _where("Firewall rule modified", with_command=True), tactic,
            "T1562.004 - Disable or Modify System Firewall", "Confirm the firewall change was planned.", WITH_COMMAND,
        ),
    ]


def persistence(s: DetectorSettings) -> list[RowRule]:
    tactic, run_label = "Persistence", "T1547.001 - Registry Run Keys / Startup Folder"
    shell = contains_any("lower(raw_json)", ["powershell", "cmd"])
    startup = f"{contains_any('lower(raw_json)', STARTUP_FOLDERS)} OR {contains_any('lower(command_line)', STARTUP_FOLDERS)}"
    return [
        RowRule(
            "persistence", F.expr("event_id = 7045"), "New Service Created",
            F.expr(f"CASE WHEN {shell} THEN 'critical' ELSE 'high' END"), _where("New service installed"),
            tactic, "T1543.003 - Windows Service", "Check the binary and the account of the service.", WITH_COMMAND,
        ),
        RowRule(
            "persistence", F.expr("event_id = 4698"), "Scheduled Task Created", "high", _where("Scheduled task created"),
            tactic, "T1053.005 - Scheduled Task", "Check what the task runs and when.", WITH_COMMAND,
        ),
        RowRule(
            "persistence", F.expr(f"event_id = 13 AND {contains_any('lower(raw_json)', RUN_KEYS)}"),
            "Registry Run Key Modified", "high", _where("Registry Run/RunOnce key modified"), tactic, run_label,
            "Check the program the run key starts.", WITH_PROCESS,
        ),
        RowRule(
            "persistence", F.expr(f"event_id <> 13 AND ({startup})"), "Startup Folder Modified", "medium",
            _where("Startup folder modification detected"), tactic, run_label,
            "Check the file that was placed in the startup folder.", WITH_COMMAND,
        ),
    ]


def exfiltration(s: DetectorSettings) -> list[RowRule]:
    archived, staged = any_search("command_line", ARCHIVE_PATTERNS), any_search("command_line", STAGING_PATTERNS)
    return [
        RowRule(
            "exfiltration", F.expr(f"command_line <> '' AND {archived}"), "Suspicious Archive Creation", "high",
            _where("Archive tool used targeting sensitive paths", with_command=True), "Exfiltration",
            "T1560.001 - Archive via Utility", "Find out what was archived and where it went.", WITH_COMMAND,
        ),
        RowRule(
            "exfiltration", F.expr(f"command_line <> '' AND {staged} AND NOT {archived}"), "Data Staging Detected",
            "medium", _where("File staging activity", with_command=True), "Exfiltration", "T1074 - Data Staged",
            "Confirm the transfer was planned.", WITH_COMMAND,
        ),
    ]


def kerberos_attacks(s: DetectorSettings) -> list[RowRule]:
    weak = f"contains(lower(raw_json), {lit(WEAK_ENCRYPTION)})"

    def ticket(kind: str, account: str) -> Column:
        return F.expr(
            f"concat({lit(f'{kind} request with RC4 encryption for {account} ' + chr(39))}, {TARGET_OR_USER}, "
            f"{lit(chr(39) + ' on ')}, computer)"
        )

    return [
        RowRule(
            "kerberos_attacks",
            F.expr(f"event_id = 4769 AND {weak} AND {TARGET_OR_USER} <> '' AND NOT endswith({TARGET_OR_USER}, '$')"),
            "Potential Kerberoasting", "high", ticket("TGS", "non-machine account"), "Credential Access",
            "T1558.003 - Kerberoasting", "Review the requester and change the service account's password.", TICKET,
        ),
        RowRule(
            "kerberos_attacks", F.expr(f"event_id = 4768 AND {weak}"), "Potential AS-REP Roasting", "high",
            ticket("TGT", "account"), "Credential Access", "T1558.004 - AS-REP Roasting",
            "Turn Kerberos pre-authentication on for the account.", TICKET,
        ),
    ]


def credential_access(s: DetectorSettings) -> list[RowRule]:
    def record(key: str) -> str:
        paths = [json_path(key), json_path("EventData", key)]
        found = ", ".join(f"try_variant_get(try_parse_json(raw_json), {lit(p)}, 'string')" for p in paths)
        return f"lower(coalesce({found}, ''))"

    tactic = "Credential Access"
    rules = [
        RowRule(
            "credential_access", F.expr(f"event_id = 10 AND endswith({record('TargetImage')}, 'lsass.exe')"),
            "LSASS Memory Access", "critical", _where("LSASS process opened"), tactic, "T1003.001 - LSASS Memory",
            "Check which program opened LSASS.", WITH_PROCESS,
        ),
        RowRule(
            "credential_access", F.expr("event_id = 4663 AND contains(" + record("ObjectName") + ", " + lit("\\sam") + ")"),
            "SAM Hive Access", "critical", _where("SAM registry hive read"), tactic,
            "T1003.002 - Security Account Manager", "Check which program read the SAM hive.", WITH_PROCESS,
        ),
    ]
    if s.replication_guids:
        guids = contains_any("lower(raw_json)", [g.lower() for g in s.replication_guids])
        rules.append(
            RowRule(
                "credential_access", F.expr(f"event_id = 4662 AND {guids}"), "Directory Replication Request", "critical",
                _where("Directory replication requested"), tactic, "T1003.006 - DCSync",
                "Check that the requester is a domain controller.", BASIC,
            )
        )
    return rules


def initial_access(s: DetectorSettings) -> list[RowRule]:
    success, quote = f"event_id = 4624 AND NOT {QUIET}", lit(chr(39))
    early, late = s.business_hours_start, s.business_hours_end
    return [
        RowRule(
            "initial_access",
            F.expr(f"{success} AND logon_type = 10 AND source_ip <> ''") & ~is_private_ip("source_ip"),
            "External RDP Logon", "high",
            F.expr(
                f"concat('Remote interactive logon from external IP ', source_ip, ' to ', computer, ' as ', {quote}, "
                f"{TARGET_OR_USER}, {quote})"
            ),
            "Initial Access", "T1078 - Valid Accounts", "Confirm that the account's owner logged on from this address.", LOGON,
        ),
        RowRule(
            "initial_access", F.expr(f"{success} AND (hour(event_ts) < {early} OR hour(event_ts) >= {late})"),
            "After-Hours Logon", "low",
            F.expr(
                f"concat('Logon outside business hours ({early}:00-{late}:00) by ', {quote}, {TARGET_OR_USER}, {quote}, "
                f"' at ', {EVENT_TIME}, ' on ', computer)"
            ),
            "Initial Access", "T1078 - Valid Accounts", "Confirm that the account's owner was expected at this hour.",
            {**LOGON, "hour": "hour(event_ts)"},
        ),
    ]


STATELESS_DETECTORS = {
    "suspicious_process": suspicious_process,
    "defense_evasion": defense_evasion,
    "persistence": persistence,
    "exfiltration": exfiltration,
    "kerberos_attacks": kerberos_attacks,
    "credential_access": credential_access,
    "initial_access": initial_access,
}


def stateless_rules(settings: DetectorSettings | None = None, detectors: Iterable[str] | None = None) -> list[RowRule]:
    """Rules of the single-event detectors (all of them, or the named ones).

    ``raw_json`` is searched as text, like a record dump.
    """
    names = STATELESS_DETECTORS if detectors is None else detectors
    return [rule for name in names for rule in STATELESS_DETECTORS[name](settings or DetectorSettings())]
