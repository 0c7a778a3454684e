"""What a statement does, read off the nodes and expressions of Catalyst's unresolved tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

#: Functions whose use counts as aggregation.
AGGREGATES = ["avg", "count", "max", "min", "sum", "stddev", "variance"]


def parsed(spark: SparkSession, sql: str):
    """Catalyst's parse of a statement, or null."""
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException:
        return None


def listed(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def kind(node) -> str:
    return node.getClass().getSimpleName()


@dataclass
class Names:
    """What the part of a statement above a node can name: results of nodes below, and tables by alias."""

    made: set[str] = field(default_factory=set)
    stored: set[str] = field(default_factory=set)

    def __or__(self, other: Names) -> Names:
        return Names(self.made | other.made, self.stored | other.stored)


class Walk:
    """columns, tables, aggregates, limits and node names of a statement.

    A name is a column unless something below it in the tree makes it: the alias of an expression in a derived table, in
    a common table expression or under ORDER BY and HAVING. Names after the alias of a stored table are always columns. An
    alias that the same select list uses again counts as a column, since only the tables' columns could tell."""

    def __init__(self, plan) -> None:
        self.columns: set[str] = set()
        self.tables: set[str] = set()
        self.aggregates: set[str] = set()
        self.limits: list[str] = []
        self.nodes: set[str] = set()
        self.grouped = False
        self._made_by_cte: dict[str, Names] = {}
        self._plan(plan, Names())

    def _plan(self, node, outer: Names) -> Names:
        """Visit a node after what is below it; what it makes known to the nodes above."""
        name = kind(node)
        self.nodes.add(name)
        match name:
            case "GlobalLimit":
                self.limits.append(node.limitExpr().toString())
            case "UnresolvedWith":
                shadowed = dict(self._made_by_cte)
                for pair in listed(node.cteRelations()):
                    self._made_by_cte[pair._1().lower()] = self._plan(pair._2().child(), outer)
                below = self._plan(node.child(), outer)
                self._made_by_cte = shadowed
                return below
            case "UnresolvedRelation":
                parts = listed(node.multipartIdentifier())
                if len(parts) == 1 and parts[0].lower() in self._made_by_cte:
                    return Names(self._made_by_cte[parts[0].lower()].made)
                self.tables.add(parts[-1])
                return Names(set(), {parts[-1].lower()})
        below = Names()
        for child in listed(node.children()):
            below |= self._plan(child, outer)
        if name == "SubqueryAlias":
            stored = kind(node.child()) == "UnresolvedRelation" and bool(below.stored)
            return Names(below.made, {node.alias().lower()} if stored else set())
        expressions = listed(node.expressions())
        own = {e.name().lower() for e in expressions if kind(e) == "Alias"}
        if name == "Generate":
            own = {listed(e.nameParts())[-1].lower() for e in listed(node.generatorOutput())}
            expressions = listed(node.generator().children())
        scope = below | outer
        keys = listed(node.groupingExpressions()) if name == "Aggregate" else []
        self.grouped |= bool(keys)
        named = {parts[-1].lower() for e in expressions if kind(e) == "Alias" for parts in self._attributes(e)}
        for e in expressions:
            # GROUP BY may name an alias of its own select list; a column of this name would come first
            by_alias = kind(e) == "UnresolvedAttribute" and any(e.equals(k) for k in keys) and own - named
            self._expression(e, scope | Names(own - named) if by_alias else scope)
        return Names(below.made | own, below.stored)

    def _attributes(self, e) -> Iterator[list[str]]:
        if kind(e) == "UnresolvedAttribute":
            yield listed(e.nameParts())
        for child in listed(e.children()):
            yield from self._attributes(child)

    def _expression(self, e, scope: Names) -> None:
        match kind(e):
            case "UnresolvedAttribute":
                parts = listed(e.nameParts())
                at = next((k for k in range(len(parts) - 1) if parts[k].lower() in scope.stored), None)
                if at is not None:
                    self.columns.add(parts[at + 1])
                elif parts[-1].lower() not in scope.made:
                    self.columns.add(parts[-1])
            case "UnresolvedFunction":
                called = listed(e.nameParts())[-1].lower()
                if called in AGGREGATES:
                    self.aggregates.add(called.upper())
            case "ScalarSubquery" | "ListQuery" | "Exists" | "LateralSubquery" | "FunctionTableSubqueryArgumentExpression":
                self._plan(e.plan(), scope)
        for child in listed(e.children()):
            self._expression(child, scope)


def walked(spark: SparkSession, sql: str) -> Walk | None:
    """The walk over a statement; null where it can't be parsed."""
    plan = parsed(spark, sql)
    return None if plan is None else Walk(plan)
