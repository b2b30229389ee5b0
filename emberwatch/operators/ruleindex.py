"""Which rules an event can match at all: an index over the fixed texts of many rules.

A rule that can be indexed names texts of which one must be in an event's field for the rule
to match: whole values, or parts of them. Whole values become tokens ``field=value``; of a
part its rarest stretch of five (or three) letters becomes a token ``field~stretch``. An
event's own tokens meet them in one join, so an event costs as many look-ups as its fields have
letters, however many rules there are. Rules are kept in groups; only the groups an event's
tokens lead to are evaluated for it, exactly.
"""

from __future__ import annotations

import ast
import re
from collections import Counter
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions.sqltext import lit

STRETCHES = (5, 3)  # lengths of indexed stretches; shorter texts are not indexed


@dataclass(frozen=True)
class Literal:
    """A lower-case text that a field (SQL text) holds, or is if ``whole``."""

    field: str
    text: str
    whole: bool = False

    @property
    def usable(self) -> bool:
        return self.whole or len(self.text) >= STRETCHES[-1]


Literals = frozenset[Literal]


def any_of(parts: Iterable[Literals | None]) -> Literals | None:
    """Texts of which one is there if one of the parts holds; None if a part has none."""
    out: set[Literal] = set()
    for part in parts:
        if part is None:
            return None
        out |= part
    return frozenset(out)


def all_of(parts: Iterable[Literals | None]) -> Literals | None:
    """Texts of which one is there if all parts hold: those of the part with the fewest and longest."""
    known = [p for p in parts if p is not None]
    return min(known, key=lambda p: (len(p), -min((len(x.text) for x in p), default=0))) if known else None


def of_condition(sql: str, selections: Mapping[str, Literals | None]) -> Literals | None:
    """Texts of a boolean SQL expression over selection columns in backticks."""
    names = list(selections)
    numbered = sql
    for k, name in enumerate(names):
        numbered = numbered.replace(f"`{name}`", f" s{k} ")
    words = {"AND": "and", "OR": "or", "NOT": "not", "true": "True", "false": "False"}
    python = re.sub(r"\b(AND|OR|NOT|true|false)\b", lambda m: words[m.group(1)], numbered).strip()
    try:
        return _of_node(ast.parse(python, mode="eval").body, [selections[n] for n in names])
    except (SyntaxError, ValueError):
        return None


def _of_node(node: ast.expr, values: list[Literals | None]) -> Literals | None:
    if isinstance(node, ast.BoolOp):
        parts = [_of_node(x, values) for x in node.values]
        return any_of(parts) if isinstance(node.op, ast.Or) else all_of(parts)
    if isinstance(node, ast.Name):
        return values[int(node.id[1:])]
    if isinstance(node, ast.Constant) and node.value is False:
        return frozenset()
    return None  # a negation, or always true


def _stretches(text: str) -> list[str]:
    size = next(n for n in STRETCHES if len(text) >= n)
    return [text[k : k + size] for k in range(len(text) - size + 1)]


class RuleIndex:
    """Tokens of groups of rules; ``literals[k]`` are those of group k's rules."""

    def __init__(self, literals: list[list[Literals]]):
        seen = Counter(s for group in literals for rule in group for x in rule if not x.whole for s in set(_stretches(x.text)))
        self.fields = sorted({x.field for group in literals for rule in group for x in rule})
        self.whole = {x.field for group in literals for rule in group for x in rule if x.whole}
        self.sizes: dict[str, set[int]] = {f: set() for f in self.fields}
        self.tokens: set[tuple[str, int]] = set()
        for k, group in enumerate(literals):
            for x in {x for rule in group for x in rule}:
                number = self.fields.index(x.field)
                if x.whole:
                    self.tokens.add((f"{number}={x.text}", k))
                else:
                    rarest = min(_stretches(x.text), key=lambda s: (seen[s], s))
                    self.sizes[x.field].add(len(rarest))
                    self.tokens.add((f"{number}~{rarest}", k))

    def event_tokens(self) -> str:
        """SQL array of an event's distinct tokens."""
        arrays = []
        for number, field in enumerate(self.fields):
            text = f"lower({field})"
            if field in self.whole:
                arrays.append(f"array(concat({lit(f'{number}=')}, {text}))")
            for size in sorted(self.sizes[field]):
                # ``filter`` binds the lower-cased text once; short texts have no stretch.
                arrays.append(
                    f"flatten(transform(filter(array({text}), x -> length(x) >= {size}), "
                    f"x -> transform(sequence(1, length(x) - {size - 1}), i -> concat({lit(f'{number}~')}, substring(x, i, {size})))))"
                )
        return f"array_distinct(concat({', '.join(arrays)}))"

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.tokens), "token string, rule_group int")

    def candidates(self, events: DataFrame) -> DataFrame:
        """Events with each ``rule_group`` that their tokens lead to, once."""
        numbered = events.withColumn("_row", F.monotonically_increasing_id())
        tokens = numbered.select("*", F.explode(F.expr(self.event_tokens())).alias("token"))
        # The rules bound the table: a few tokens each.
        met = tokens.join(F.broadcast(self.table(events.sparkSession)), "token").drop("token")
        return met.dropDuplicates(["_row", "rule_group"]).drop("_row")
