"""The syntax tree, and back to text."""

from __future__ import annotations

from dataclasses import dataclass, field


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None = None

    @property
    def handle(self) -> str:
        return self.alias or self.name

    def to_sql(self) -> str:
        return f"{self.name} AS {self.alias}" if self.alias else self.name


@dataclass(frozen=True)
class Column:
    """A column; table is the handle of its table once it is resolved, declared its declared type."""

    name: str
    qualifier: str | None = None
    cast: str | None = None
    table: str | None = None
    declared: str | None = None

    def to_sql(self) -> str:
        text = f"{self.qualifier}.{self.name}" if self.qualifier else self.name
        return f"({self.cast}){text}" if self.cast else text


@dataclass(frozen=True)
class Literal:
    """A number (as written) or a string."""

    text: str
    is_string: bool = False
    cast: str | None = None

    def to_sql(self) -> str:
        text = quoted(self.text) if self.is_string else self.text
        return f"({self.cast}){text}" if self.cast else text


Operand = Column | Literal


@dataclass(frozen=True)
class Comparison:
    left: Operand
    operator: str
    right: Operand

    def to_sql(self) -> str:
        return f"{self.left.to_sql()} {self.operator} {self.right.to_sql()}"


@dataclass(frozen=True)
class Test:
    """An extension: operand [NOT] IS NULL, BETWEEN, IN or LIKE."""

    operand: Operand
    kind: str
    values: tuple[Operand, ...] = ()
    negated: bool = False

    def to_sql(self) -> str:
        no = "NOT " if self.negated else ""
        head, values = self.operand.to_sql(), [v.to_sql() for v in self.values]
        if self.kind == "NULL":
            return f"{head} IS {no}NULL"
        if self.kind == "BETWEEN":
            return f"{head} {no}BETWEEN {values[0]} AND {values[1]}"
        return f"{head} {no}IN ({', '.join(values)})" if self.kind == "IN" else f"{head} {no}LIKE {values[0]}"


@dataclass(frozen=True)
class Not:
    inner: Condition

    def to_sql(self) -> str:
        return f"NOT ({self.inner.to_sql()})"


@dataclass(frozen=True)
class Logical:
    """AND or OR of two conditions."""

    operator: str
    left: Condition
    right: Condition

    def to_sql(self) -> str:
        def side(x: Condition) -> str:
            text = x.to_sql()
            return f"({text})" if isinstance(x, Logical) and x.operator != self.operator else text

        return f"{side(self.left)} {self.operator} {side(self.right)}"


Condition = Comparison | Test | Not | Logical


@dataclass(frozen=True)
class Item:
    column: Column
    alias: str | None = None

    @property
    def header(self) -> str:
        return self.alias or self.column.name

    def to_sql(self) -> str:
        return f"{self.column.to_sql()} AS {self.alias}" if self.alias else self.column.to_sql()


@dataclass(frozen=True)
class Aggregate:
    """FUNC(column); column is None for COUNT(*)."""

    function: str
    column: Column | None
    alias: str | None = None

    @property
    def header(self) -> str:
        return self.alias or self.function

    def to_sql(self) -> str:
        text = f"{self.function}({self.column.to_sql() if self.column else '*'})"
        return f"{text} AS {self.alias}" if self.alias else text


@dataclass(frozen=True)
class Join:
    """kind: INNER, CROSS, LEFT, RIGHT or FULL."""

    kind: str
    table: Table
    on: tuple[Comparison, ...]

    def to_sql(self) -> str:
        outer = " OUTER" if self.kind in ("LEFT", "RIGHT", "FULL") else ""
        return f"{self.kind}{outer} JOIN {self.table.to_sql()} ON {' AND '.join(c.to_sql() for c in self.on)}"


@dataclass(frozen=True)
class Query:
    """items is empty for `*`."""

    tables: tuple[Table, ...]
    items: tuple[Item, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    top: int | None = None
    percent: bool = False
    distinct: bool = False
    joins: tuple[Join, ...] = ()
    where: Condition | None = None
    order: tuple[tuple[Column, bool], ...] = field(default=())
    limit: int | None = None

    def to_sql(self) -> str:
        out = ["SELECT"]
        if self.distinct:
            out.append("DISTINCT")
        if self.top is not None:
            out.append(f"TOP {self.top}" + " PERCENT" * self.percent)
        out.append(", ".join(x.to_sql() for x in (*self.aggregates, *self.items)) or "*")
        out.append("FROM " + ", ".join(t.to_sql() for t in self.tables))
        out += [j.to_sql() for j in self.joins]
        if self.where is not None:
            out.append("WHERE " + self.where.to_sql())
        if self.order:
            out.append("ORDER BY " + ", ".join(c.to_sql() + ("" if up else " DESC") for c, up in self.order))
        if self.limit is not None:
            out.append(f"LIMIT {self.limit}")
        return " ".join(out)


def columns(condition: Condition | None) -> list[Column]:
    """The columns of a condition, from left to right."""
    if condition is None:
        return []
    if isinstance(condition, Logical):
        return columns(condition.left) + columns(condition.right)
    if isinstance(condition, Not):
        return columns(condition.inner)
    sides = (condition.operand, *condition.values) if isinstance(condition, Test) else (condition.left, condition.right)
    return [x for x in sides if isinstance(x, Column)]
