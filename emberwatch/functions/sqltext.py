"""SQL text for long predicates.

A predicate over dozens of patterns is parsed by Spark in one call this way; built column
by column it would cost hundreds of calls from Python to the JVM per query.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

# Case-insensitive with Unicode case folding, word characters and boundaries.
UNICODE_ICASE = "(?iuU)"


def lit(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def search(text: str, pattern: str) -> str:
    return f"({text}) RLIKE {lit(UNICODE_ICASE + pattern)}"


def any_search(text: str, patterns: Iterable[str]) -> str:
    return "(" + " OR ".join(search(text, p) for p in patterns) + ")"


def contains_any(text: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def in_list(text: str, values: Iterable[str]) -> str:
    return f"{text} IN ({', '.join(lit(v) for v in values)})"


def first_match(cases: Iterable[tuple[str, str]], default: str) -> str:
    arms = " ".join(f"WHEN {test} THEN {value}" for test, value in cases)
    return f"CASE {arms} ELSE {default} END"


def lookup(table: Mapping, key: str, default: str) -> str:
    """``table[key]`` for a small fixed table of numbers or texts."""

    def item(x) -> str:
        return lit(x) if isinstance(x, str) else str(x)

    pairs = ", ".join(f"{item(k)}, {item(v)}" for k, v in table.items())
    return f"coalesce(try_element_at(map({pairs}), {key}), {default})"


def first_text(*columns: str) -> str:
    """First non-empty text, else ``''``."""
    return "coalesce(" + ", ".join(f"nullif({c}, '')" for c in columns) + ", '')"


TARGET_OR_USER = first_text("target_username", "username")
USER_OR_TARGET = first_text("username", "target_username")
EVENT_TIME = "substring(cast(event_ts as string), 1, 19)"
