"""Results as text."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame

PAGE = 32


def text(value) -> str:
    """A cell; null is empty."""
    return "" if value is None else str(value).replace("\n", " ")


def pages(df: DataFrame, page: int = PAGE, underline: bool = True, framed: bool = False, numbers: bool = False, paged: bool = True) -> Iterator[str]:
    """The result in pages of text. Rows are fetched as pages are asked for; an unpaged result is one text."""
    names = (["#"] if numbers else []) + df.columns
    rows = df.toLocalIterator()
    count, first = 0, True
    while True:
        part = list(islice(rows, page)) if paged else list(rows)
        if not part and not first:
            return
        cells = [([str(count + i)] if numbers else []) + [text(v) for v in row] for i, row in enumerate(part, 1)]
        count += len(part)
        width = [max([len(n), *(len(r[i]) for r in cells)]) for i, n in enumerate(names)]
        bar, edge = (" | ", "|") if framed else ("  ", "")
        line = lambda r: (f"{edge} " if framed else "") + bar.join(c.ljust(w) for c, w in zip(r, width)).rstrip(None if not framed else "") + (f" {edge}" if framed else "")
        rule = "+" + "+".join("-" * (w + 2) for w in width) + "+" if framed else "  ".join("-" * w for w in width)
        out = ([rule] if framed else []) + [line(names)] + ([rule] if framed or underline else []) + [line(r) for r in cells] + ([rule] if framed else [])
        yield "\n".join(out)
        first = False
        if not paged:
            return


def show(df: DataFrame, **options) -> int:
    """Print all pages; returns their number."""
    n = 0
    for n, page in enumerate(pages(df, **options), 1):
        print(page)
    return n
