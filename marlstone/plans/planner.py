"""A bound query as a DataFrame.

The plan is declared and nothing is executed, except that TOP n PERCENT counts its rows first.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.dialect import nodes as N
from marlstone.functions.aggregates import aggregate
from marlstone.functions.types import cast, compare

#: How a join is called in Spark. CROSS JOIN has an ON clause here.
JOINS = {"INNER": "inner", "CROSS": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full"}


def column(node: N.Column) -> Column:
    out = F.col(f"`{node.table}`.`{node.name}`")
    return cast(out, node.cast) if node.cast else out


def operand(node: N.Operand) -> Column:
    if isinstance(node, N.Column):
        return column(node)
    if node.is_string:
        out = F.lit(node.text)
    elif "." in node.text:
        out = F.lit(float(node.text))
    else:
        value = int(node.text)
        out = F.lit(value) if abs(value) < 1 << 63 else F.lit(node.text).cast("decimal(38,0)")
    return cast(out, node.cast) if node.cast else out


def condition(node: N.Condition) -> Column:
    if isinstance(node, N.Logical):
        left, right = condition(node.left), condition(node.right)
        return left & right if node.operator == "AND" else left | right
    if isinstance(node, N.Not):
        return ~condition(node.inner)
    if isinstance(node, N.Test):
        value = operand(node.operand)
        if node.kind == "NULL":
            return value.isNotNull() if node.negated else value.isNull()
        if node.kind == "BETWEEN":
            out = value.between(operand(node.values[0]), operand(node.values[1]))
        elif node.kind == "IN":
            out = value.isin(*map(operand, node.values))
        else:
            out = value.like(node.values[0].text)
        return ~out if node.negated else out
    return compare(operand(node.left), node.operator, operand(node.right))


def leading(where: N.Condition | None) -> N.Column | None:
    """The column whose order a condition implies: the leftmost one, unless the condition is an OR."""
    if where is None or isinstance(where, N.Logical) and where.operator == "OR":
        return None
    found = N.columns(where)
    return found[0] if found else None


def plan(query: N.Query, table: Callable[[str], DataFrame], keys: Callable[[str], list[str]], columns_of: Callable[[str], list[str]], strict: bool = False) -> DataFrame:
    """Build the DataFrame of a resolved query.

    Rows have no order unless ORDER BY or TOP gives one. TOP takes the first rows by the column that the condition
    leads with, then the first key of the first table, then all remaining columns of the first table; without a
    condition, or with an OR, it starts with the key. Nulls come first. TOP n PERCENT takes the first
    ceil(n / 100 * rows) rows; in the strict dialect PERCENT has no effect.
    """
    frames = [table(t.name).alias(t.handle) for t in query.tables]
    out = frames[0]
    for frame in frames[1:]:
        out = out.crossJoin(frame)  # with the equalities of WHERE, the optimiser makes joins of them
    for join in query.joins:
        on = condition(join.on[0])
        for link in join.on[1:]:
            on = on & condition(link)
        out = out.join(table(join.table.name).alias(join.table.handle), on, JOINS[join.kind])
    if query.where is not None:
        out = out.where(condition(query.where))
    if query.aggregates:
        return out.agg(*(aggregate(a.function, column(a.column) if a.column else None, a.column.declared if a.column else "", strict).alias(a.header) for a in query.aggregates))
    shown = [column(i.column).alias(i.header) for i in query.items]
    if query.distinct and query.order:
        out = out.select(*shown, *(column(c).alias(f"__order{k}") for k, (c, _) in enumerate(query.order))).distinct()
        order = [F.col(f"__order{k}").asc_nulls_first() if up else F.col(f"__order{k}").desc_nulls_last() for k, (_, up) in enumerate(query.order)]
        out = out.orderBy(*order).drop(*(f"__order{k}" for k in range(len(query.order))))
    else:
        if query.order or query.top is not None:
            out = out.orderBy(*_order(query, keys, columns_of))
        if query.top is not None:
            out = out.limit(math.ceil(query.top * out.count() / 100) if query.percent and not strict else query.top)
        out = out.select(*shown)
        out = out.distinct() if query.distinct else out
    return out.limit(query.limit) if query.limit is not None else out


def _order(query: N.Query, keys: Callable[[str], list[str]], columns_of: Callable[[str], list[str]]) -> list[Column]:
    if query.order:
        return [column(c).asc_nulls_first() if up else column(c).desc_nulls_last() for c, up in query.order]
    first = query.tables[0]
    lead = leading(query.where)
    names = [(lead.table, lead.name)] if lead else []
    names += [(first.handle, k) for k in keys(first.name)[:1]]
    names += [(t.handle, c) for t in (*query.tables, *(j.table for j in query.joins)) for c in columns_of(t.name)]
    return [F.col(f"`{t}`.`{c}`").asc_nulls_first() for t, c in dict.fromkeys(names)]
