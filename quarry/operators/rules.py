"""Rules as data.

A rule table has the rows (rule_no, target, clause_no, kind, term, negate, value). A rule fires on a text when each of
its clauses does; a clause does when any of its terms hits, or, negated, when none does. Kinds: `contains`,
`contains_ci`, `regex`. A value may hold $1 to $9, which stand for the groups of the rule's first pattern that matches.
Tables are bounded (they are written by people) and compile into column expressions: no join, no shuffle, no UDF.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = "rule_no int, target string, clause_no int, kind string, term string, negate boolean, value string"


@dataclass(frozen=True)
class Rule:
    number: int
    target: str
    value: str
    clauses: tuple[tuple[bool, tuple[tuple[str, str], ...]], ...]

    def fires(self, text: Column) -> Column:
        hits = [(negate, reduce(or_, (_hit(kind, term, text) for kind, term in terms))) for negate, terms in self.clauses]
        return reduce(and_, (~hit if negate else hit for negate, hit in hits))

    def result(self, text: Column) -> Column:
        """The value, with the groups of the first pattern of the first clause filled in."""
        parts = re.split(r"(\$[1-9])", self.value)
        if len(parts) == 1:
            return F.lit(self.value)
        pattern = next(term for negate, terms in self.clauses if not negate for kind, term in terms if kind == "regex")
        return F.concat(*[F.regexp_extract(text, pattern, int(p[1])) if re.fullmatch(r"\$[1-9]", p) else F.lit(p) for p in parts if p])


def _hit(kind: str, term: str, text: Column) -> Column:
    if kind == "contains":
        return text.contains(term)
    if kind == "contains_ci":
        return F.lower(text).contains(term.lower())
    if kind == "regex":
        return text.rlike(term)
    raise ValueError(f"unknown kind of term: {kind}")


class Rules:
    """The rules of one target, in order."""

    def __init__(self, rows: Iterable[tuple], target: str | None = None) -> None:
        found: dict[int, dict] = {}
        for number, name, clause, kind, term, negate, value in sorted(rows, key=lambda r: (r[0], r[2])):
            if target is None or name == target:
                rule = found.setdefault(number, {"target": name, "value": value, "clauses": {}})
                rule["clauses"].setdefault((clause, bool(negate)), []).append((kind, term))
        self.rules = [Rule(n, r["target"], r["value"], tuple((neg, tuple(t)) for (_, neg), t in r["clauses"].items())) for n, r in found.items()]

    @classmethod
    def table(cls, rules: DataFrame, target: str | None = None, most: int = 10_000) -> Rules:
        """The rules of a table; more than `most` rows are an error."""
        rows = [tuple(r) for r in rules.select(*[c.split()[0] for c in COLUMNS.split(", ")]).limit(most + 1).collect()]
        if len(rows) > most:
            raise ValueError(f"over {most} rows of rules: too many to compile into an expression; plans.vocabulary.fired() joins tables of any size")
        return cls(rows, target)

    def first(self, text: Column, default: str = "") -> Column:
        """The value of the first rule that fires."""
        return F.coalesce(*[F.when(r.fires(text), r.result(text)) for r in self.rules], F.lit(default))

    def values(self, text: Column) -> Column:
        """The values of all rules that fire, in order, each once."""
        return F.array_distinct(F.array_compact(F.array(*[F.when(r.fires(text), r.result(text)) for r in self.rules])))

    def flags(self, text: Column) -> Column:
        """The numbers of all rules that fire."""
        return F.array_compact(F.array(*[F.when(r.fires(text), F.lit(r.number)) for r in self.rules]))

    def any(self, text: Column) -> Column:
        return reduce(or_, (r.fires(text) for r in self.rules))


def any_of(number: int, target: str, value: str, kind: str, *terms: str) -> list[tuple]:
    return [(number, target, 1, kind, t, False, value) for t in terms]


def all_of(number: int, target: str, value: str, kind: str, *clauses: tuple[str, ...]) -> list[tuple]:
    return [(number, target, i, kind, t, False, value) for i, terms in enumerate(clauses, 1) for t in terms]
