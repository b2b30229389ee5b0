"""Scalar functions over message, path and label text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberwatch.schema import col

# Ordered keyword lists of the message categories.
MESSAGE_KEYWORDS = {
    "authentication": [
        "auth", "login", "logon", "logoff", "password", "pam", "sshd",
        "sudo", "su:", "failed", "accepted", "session opened", "session closed",
    ],
    "process": ["process", "exec", "command", "started", "stopped", "killed", "fork"],
    "network": [
        "connection", "connect", "listen", "port", "firewall", "iptables", "tcp", "udp", "dns",
    ],
    "privilege": ["privilege", "sudo", "root", "admin", "escalat"],
    "file": ["file", "open", "read", "write", "delete", "created", "modified"],
}

# Ordered message patterns and the event id each stands for.
MESSAGE_EVENT_IDS = [
    (r"\bfailed password\b", 4625),
    (r"\bauthentication failure\b", 4625),
    (r"\binvalid user\b", 4625),
    (r"\baccepted password\b", 4624),
    (r"\baccepted publickey\b", 4624),
    (r"\bsession opened\b", 4624),
    (r"\bsession closed\b", 4634),
    (r"\bsudo:.*COMMAND=", 4688),
]

# Ordered user patterns; the first that matches gives its group 1.
USER_PATTERNS = [
    r"user[= ]+['\"]?(\w+)",
    r"for (?:invalid user )?(\w+)\s+from",
    r"session (?:opened|closed) for user (\w+)",
    r"(?:Accepted|Failed) \S+ for (\w+)\s+from",
]

# Fixed values.
IP_PATTERN = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
TECHNIQUE_PATTERN = r"(T\d{4}(?:\.\d{3})?)"

# Case-insensitive with Unicode case folding, word characters and boundaries.
UNICODE_ICASE = "(?iuU)"
UNICODE = "(?U)"


def search(text: str | Column, pattern: str) -> Column:
    """Case-insensitive regex search."""
    return col(text).rlike(UNICODE_ICASE + pattern)


def contains_any(text: Column, words: list[str]) -> Column:
    test = F.lit(False)
    for word in words:
        test = test | text.contains(word)
    return test


def first_match(cases: list[tuple[Column, object]], default) -> Column:
    """CASE over ordered (test, value) pairs."""
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default)


def message_category(message: str | Column) -> Column:
    low = F.lower(col(message))
    cases = [(contains_any(low, words), name) for name, words in MESSAGE_KEYWORDS.items()]
    return first_match(cases, "unknown")


def message_event_id(message: str | Column, fallback: Column) -> Column:
    cases = [(search(message, pattern), event_id) for pattern, event_id in MESSAGE_EVENT_IDS]
    return first_match(cases, fallback)


def message_user(message: str | Column) -> Column:
    found = [
        F.nullif(F.regexp_extract(col(message), UNICODE_ICASE + p, 1), F.lit(""))
        for p in USER_PATTERNS
    ]
    return F.coalesce(*found, F.lit(""))


def message_ip(message: str | Column) -> Column:
    return F.regexp_extract(col(message), UNICODE + IP_PATTERN, 1)


def path_leaf(path: str | Column) -> Column:
    """Lower-cased text after the last backslash."""
    return F.element_at(F.split(F.lower(col(path)), r"\\"), -1)


def tool_name(path: str | Column) -> Column:
    """Leaf of a program path without ``.exe``."""
    return F.replace(path_leaf(path), F.lit(".exe"), F.lit(""))


def number_or_zero(text: str | Column) -> Column:
    return F.coalesce(F.trim(col(text)).try_cast("double"), F.lit(0.0))


def technique_ids(technique: str | Column, tactic: str | Column) -> Column:
    """All ATT&CK technique ids in the two labels, in order of appearance."""
    return F.regexp_extract_all(F.concat_ws(" ", col(technique), col(tactic)), F.lit(TECHNIQUE_PATTERN), F.lit(1))


def entropy_sql(label: str) -> str:
    """SQL for the Shannon entropy in bits; ``label`` is bound to a name first, so it is evaluated once."""
    share = "((length(l) - length(replace(l, c, ''))) / length(l))"
    body = (
        "CASE WHEN l = '' THEN 0D ELSE aggregate(filter(array_distinct(split(l, '')), c -> c <> ''), 0D, "
        f"(total, c) -> total - {share} * log2({share})) + 0D END"
    )
    return f"get(transform(array({label}), l -> {body}), 0)"


def label_entropy(label: str) -> Column:
    """Shannon entropy of the characters of a text column in bits; 0 for empty text."""
    return F.expr(entropy_sql(label))


def first_label(name: str | Column) -> Column:
    """DNS name up to the first dot."""
    return F.substring_index(col(name), ".", 1)


def parent_domain(name: str | Column) -> Column:
    """DNS name after the first dot; ``''`` without a dot."""
    name = col(name)
    at = F.instr(name, ".")
    return F.when(at > 0, name.substr(at + 1, F.length(name))).otherwise("")
