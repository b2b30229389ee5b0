"""Thresholds of the detectors."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DetectorSettings:
    brute_force_threshold: int = 5
    brute_force_window: int = 300
    lateral_host_threshold: int = 3
    lateral_window: int = 600
    recon_threshold: int = 3
    recon_window: int = 120
    dns_query_threshold: int = 25
    dns_window_seconds: int = 60
    dns_min_label_length: int = 20
    dns_min_entropy_bits: float = 3.5
    chain_window: int = 3600
    chain_min_stages: int = 2
    business_hours_start: int = 6
    business_hours_end: int = 20
    replication_guids: tuple[str, ...] = ()  # no list is built in; pass the ones to watch


# Which alerts each detector raises, for the catalogue and for excluding by name.
# (detector, name, description, tactic, technique)
CATALOG = [
    ("brute_force", "Brute-Force / Password Spray", "Bursts of failed logons from one source", "Credential Access", "T1110 - Brute Force"),
    ("lateral_movement", "Lateral Movement", "One account logging on to many hosts in a short time", "Lateral Movement", "T1021 - Remote Services"),
    ("privilege_escalation", "Privilege Escalation", "Sensitive privileges given to an ordinary account", "Privilege Escalation", "T1134 - Access Token Manipulation"),
    ("suspicious_process", "Suspicious Process Execution", "Commonly abused programs with telling command lines", "Execution", "T1059 - Command and Scripting Interpreter"),
    ("defense_evasion", "Defense Evasion", "Tampering with logs, audit policy, firewall or endpoint protection", "Defense Evasion", "T1070 - Indicator Removal"),
    ("persistence", "Persistence Mechanism", "New services, tasks, run keys and startup items", "Persistence", "T1543 - Create or Modify System Process"),
    ("discovery", "Discovery / Reconnaissance", "Bursts of discovery commands by one user", "Discovery", "T1082 - System Information Discovery"),
    ("exfiltration", "Data Exfiltration", "Archiving of sensitive paths and staging of files", "Exfiltration", "T1560 - Archive Collected Data"),
    ("dns_exfiltration", "DNS Exfiltration / Tunneling", "Bursts of high-entropy DNS names from one host", "Exfiltration", "T1048.003 - Exfiltration Over Unencrypted Non-C2 Protocol"),
    ("kerberos_attacks", "Kerberos Attacks", "Ticket requests with weak encryption", "Credential Access", "T1558 - Steal or Forge Kerberos Tickets"),
    ("credential_access", "Credential Access", "Access to LSASS, the SAM hive or directory replication", "Credential Access", "T1003 - OS Credential Dumping"),
    ("initial_access", "Initial Access", "Remote logons from outside and logons after hours", "Initial Access", "T1078 - Valid Accounts"),
    ("attack_chain", "Attack Chain Correlation", "Several attack stages of one account close together", "Multiple", "Multi-stage"),
]
