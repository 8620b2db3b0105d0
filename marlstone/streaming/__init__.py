"""Queries of the dialect over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marlstone.dialect.parser import parse
from marlstone.dialect.validator import FrameValidator, resolve
from marlstone.errors import ParseError
from marlstone.plans.planner import plan


def stream_sql(frames: dict[str, DataFrame], text: str, strict: bool = False) -> DataFrame:
    """A query whose tables may be streams. TOP, LIMIT and ORDER BY need all rows and are refused."""
    catalog = FrameValidator(frames)
    query = resolve(parse(text, strict), catalog, strict)
    if query.top is not None or query.limit is not None or query.order:
        raise ParseError("a stream has no first rows")
    return plan(query, frames.__getitem__, lambda t: [], catalog.columns_of, strict)
