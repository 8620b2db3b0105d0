"""Best-fit packing: length patterns by non-negative least squares, then exact best fit for what they leave.

Only the histogram of piece lengths, at most `size` numbers, reaches the driver. There the plan is made: patterns of a
few coarse lengths are enumerated, their repeat counts fitted to the histogram by non-negative least squares and
rounded, each pattern is filled with exact lengths, and the rest goes best fit first into the space left and into new
sequences. The plan is a bounded list of runs, "pieces r to r + n of length l go to sequences s to s + n at offset o",
which every task looks up by the rank of a piece within its length.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import each_batch, pick, stage, text_slices
from marlstone.llm.tokens import END_ID, coder


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 2000) -> np.ndarray:
    """min ||a x - b|| with x >= 0, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    w = a.T @ b
    limit = 1e-9 * max(1.0, float(np.abs(w).max(initial=0)))
    for _ in range(steps):
        free = np.where(passive, -np.inf, w)
        j = int(np.argmax(free))
        if free[j] <= limit:
            break
        passive[j] = True
        while True:
            index = np.flatnonzero(passive)
            s = np.zeros(n)
            s[index] = np.linalg.lstsq(a[:, index], b, rcond=None)[0]
            bad = index[s[index] <= 0]
            if not len(bad):
                break
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                s = x
                break
        x = s
        w = a.T @ (b - a @ x)
    return x


def patterns(total: int, parts: int, least: int) -> list[tuple[int, ...]]:
    """Every multiset of at most `parts` numbers, none below `least`, that sums to total; largest number first."""
    out = []

    def extend(head: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < parts:
            for k in range(min(most, left), least - 1, -1):
                extend((*head, k), left - k, k)

    extend((), total, total)
    return out


class _Run:
    """`count` sequences alike: slots of (length, first rank), and the free space of each."""

    __slots__ = ("count", "free", "slots")

    def __init__(self, count: int, free: int, slots: list[tuple[int, int]]):
        self.count, self.free, self.slots = count, free, slots

    def split(self, n: int) -> _Run:
        """Take the first n sequences out of this run."""
        first = _Run(n, self.free, list(self.slots))
        self.count -= n
        self.slots = [(length, rank + n) for length, rank in self.slots]
        return first


def plan(histogram: np.ndarray, size: int = 4096, unit: int = 64, parts: int = 4, least: int = 2) -> dict[str, np.ndarray]:
    """Runs that place every piece: length, rank (of the first piece, within the length), count, sequence, offset.

    histogram[l] is the number of pieces of length l, 1 <= l <= size. Time and result size depend on `size` alone.
    """
    left = np.zeros(size + 1, np.int64)
    left[: len(histogram)] = histogram
    taken = np.zeros(size + 1, np.int64)
    runs: list[_Run] = []

    def take(length: int, n: int) -> int:
        rank = int(taken[length])
        taken[length] += n
        left[length] -= n
        return rank

    if left[size]:
        n = int(left[size])
        runs.append(_Run(n, 0, [(size, take(size, n))]))
    units = -(-size // unit)
    of = -(-np.arange(size + 1) // unit)
    coarse = np.bincount(of, weights=left, minlength=units + 1)[: units + 1]
    coarse[:least] = 0
    found = [p for p in patterns(units, parts, least) if all(coarse[k] for k in p)]
    if found:
        a = np.zeros((units + 1, len(found)))
        for j, p in enumerate(found):
            for k in p:
                a[k, j] += 1
        scale = max(1.0, float(coarse.max()))
        repeats = nnls(a, coarse / scale) * scale
        for j in np.argsort(-repeats, kind="stable").tolist():
            p = found[j]
            many = {k: p.count(k) for k in p}
            n = min(int(repeats[j] + 0.5), *(int(left[(k - 1) * unit + 1 : k * unit + 1].sum()) // m for k, m in many.items()))
            if n <= 0:
                continue
            # Long pieces of one slot meet short ones of the next, so that the sums stay close.
            queues = []
            for slot, k in enumerate(p[:-1]):
                lengths = range((k - 1) * unit + 1, min(k * unit, size) + 1)
                need, queue = n, []
                for length in reversed(lengths) if slot % 2 == 0 else lengths:
                    m = int(min(need, left[length]))
                    if m:
                        queue.append([length, take(length, m), m])
                        need -= m
                queues.append(queue)
            while n:
                m = min([n, *(q[0][2] for q in queues)])
                slots = [(q[0][0], q[0][1]) for q in queues]
                n -= m
                for q in queues:
                    q[0][1] += m
                    q[0][2] -= m
                    if not q[0][2]:
                        q.pop(0)
                # The last slot takes the longest piece that fits.
                run = _Run(m, size - sum(length for length, _ in slots), slots)
                while run is not None:
                    fits = np.flatnonzero(left[1 : run.free + 1])
                    if not len(fits):
                        if run.slots:
                            runs.append(run)
                        break
                    length = int(fits[-1]) + 1
                    c = int(min(run.count, left[length]))
                    part, run = (run.split(c), run) if c < run.count else (run, None)
                    part.slots.append((length, take(length, c)))
                    part.free -= length
                    runs.append(part)
    # The rest, longest first, each into the least space that holds it.
    by_free: dict[int, list[_Run]] = defaultdict(list)
    for run in runs:
        by_free[run.free].append(run)
    spaces = sorted(by_free)

    def put(run: _Run) -> None:
        if run.free not in by_free or not by_free[run.free]:
            i = bisect.bisect_left(spaces, run.free)
            if i == len(spaces) or spaces[i] != run.free:
                spaces.insert(i, run.free)
        by_free[run.free].append(run)

    for length in range(size, 0, -1):
        while left[length]:
            n = int(left[length])
            i = bisect.bisect_left(spaces, length)
            if i < len(spaces):
                free = spaces[i]
                run = by_free[free].pop()
                if not by_free[free]:
                    spaces.pop(i)
            else:
                run = _Run(n, size, [])
            copies = min(run.free // length, n)
            m = min(run.count, n // copies)
            if m < run.count:
                rest, run = run, run.split(m)
                if rest.slots:
                    put(rest)
            for _ in range(copies):
                run.slots.append((length, take(length, m)))
            run.free -= copies * length
            put(run)
    out: dict[str, list[int]] = {k: [] for k in ("length", "rank", "count", "sequence", "offset")}
    sequence = 0
    for run in itertools.chain.from_iterable(by_free[f] for f in sorted(by_free)):
        offset = 0
        for length, rank in run.slots:
            for k, v in zip(out, (length, rank, run.count, sequence, offset)):
                out[k].append(v)
            offset += length
        sequence += run.count
    return {k: np.array(v, np.int64) for k, v in out.items()}


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most `size` ids of every whole text: doc_id, piece, start, length, ids_crc32, and part and nth.

    part and nth number the pieces of a length within the task that made them. Null text counts as empty and has the
    end id alone.
    """
    source = pick(docs, doc_id=id_col, text=text_col)
    schema = T.StructType([source.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType())])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(tokenizer, end_id).encode
        context = TaskContext.get()
        part, seen = context.partitionId() if context else 0, np.zeros(size + 1, np.int64)
        for batch in text_slices(batches, most=6_000_000):
            ids, edges = encode(batch.column(1))
            raw = memoryview(np.ascontiguousarray(ids).view(np.uint8))
            rows, pieces, starts, lengths, crc, nth = [], [], [], [], [], []
            for row, (a, b) in enumerate(itertools.pairwise(edges.tolist())):
                for piece, x in enumerate(range(a, b, size)):
                    y = min(x + size, b)
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(x - a)
                    lengths.append(y - x)
                    crc.append(zlib.crc32(raw[4 * x : 4 * y]))
                    nth.append(seen[y - x])
                    seen[y - x] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(nth, pa.int64())], names=[f.name for f in schema])

    return each_batch(source, cut_up, schema)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = END_ID) -> DataFrame:
    """Place every piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Rows with null or repeated ids are documents of their own, null text is an empty one, and an empty table gives no
    row. A document longer than `size` ids is cut; its full pieces fill a sequence each. Which of several pieces of
    one length goes where follows the order in which they were read. Other columns are ignored.
    """
    pieces, _ = stage(token_pieces(docs, tokenizer, id_col, text_col, size, end_id), "pieces")
    counts = pieces.groupBy("part", "length").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    histogram = np.zeros(size + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most `size` rows
        histogram[row["length"]] = row["n"]
    runs = plan(histogram, size)
    order = np.lexsort((runs["rank"], runs["length"]))
    runs = {k: v[order] for k, v in runs.items()}
    key = (runs["length"] << 48) + runs["rank"]
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((key, runs["rank"], runs["sequence"], runs["offset"]))
    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    schema = T.StructType([*(f for f in ranked.schema if f.name != "rank"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, sequence, offset = sent.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], names=[f.name for f in schema])

    return each_batch(ranked, place, schema)
