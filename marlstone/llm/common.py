"""What the operators of this subpackage share: staging, batches, what a process keeps, text and components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators of `words`.
ASCII_SPACE = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset, one in the warehouse.

    A session on one machine (a local master) that has no such setting gets a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
            folder = tempfile.mkdtemp(prefix="marlstone-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of the batches that Python workers get, and the setting that holds them.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextmanager
def own_shuffles(spark: SparkSession):
    """Shuffle files of the queries that run inside are deleted as soon as their results have been written."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Compute df now and cut its lineage with a reliable checkpoint, which Spark deletes with the last reference."""
    shared_dir(df.sparkSession)
    with own_shuffles(df.sparkSession):
        return df.checkpoint()


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder; returns the table that was read back, and its path.

    What nobody deletes before goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with own_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    delete_at_end(spark, path)
    return spark.read.parquet(path), path


def gathered(df: DataFrame) -> pa.Table:
    """A result of bounded size, on the driver."""
    with own_shuffles(df.sparkSession):
        return df.toArrow()


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder when the application ends."""
    system, target = _file_system(spark, path)
    system.deleteOnExit(target)


def drop_stage(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing will read again."""
    system, target = _file_system(spark, path)
    system.delete(target, True)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns only, under internal names, so that other columns cannot clash."""
    return df.select(*[df[f"`{source}`"].alias(name) for name, source in columns.items()])


def free_names(columns: list[str], wanted: tuple[str, ...]) -> dict[str, str]:
    """A name for each wanted column that no column has: its own, with as many underscores as it takes.

    Names that differ by case alone clash, as they do in Spark.
    """
    taken, out = {c.lower() for c in columns}, {}
    for name in wanted:
        free = name
        while free.lower() in taken:
            free += "_"
        taken.add(free.lower())
        out[name] = free
    return out


def quoted(columns: list[str]) -> list[str]:
    """Column names as Spark's parser takes them, whatever they hold."""
    return [f"`{c.replace('`', '``')}`" for c in columns]


def text_slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of text each; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0), dtype=np.int64)
        group = np.cumsum(size) // most
        edges = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """Texts as UTF-8."""
    return column.cast(pa.large_binary()).to_pylist()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... with lengths[0] of them, then the same from starts[1], and so on."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table: (node, component), component being the smallest node it holds.

    Alternating large-star and small-star steps: every step is one or two aggregations whose groups hold single
    minima, never a list of neighbours, and is cut by a checkpoint. Loops and repeated edges are allowed; nodes
    without an edge do not appear; null ends are dropped. An empty table gives an empty table.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    links = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small.union(low.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        # A star forest: every node has one parent, and no parent has a parent.
        unfinished = new.groupBy("u").count().where("count > 1").select("u").union(new.select(F.col("v").alias("u")).join(new, "u", "left_semi"))
        links = new
        if unfinished.isEmpty():
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Codes of all words of the texts, one after the other, the len(texts) + 1 edges between texts, and the words by code.

    Words stand between ASCII white space; null has none.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    edges = lists.offsets.to_numpy().astype(np.int64)
    found = lists.flatten().dictionary_encode()
    codes, words = found.indices.to_numpy(), found.dictionary.cast(pa.large_binary()).to_pylist()
    if b"" in words:  # stands for white space at either end
        empty = words.index(b"")
        real = codes != empty
        edges = np.concatenate([[0], np.cumsum(real)])[edges]
        codes = codes[real]
        codes = codes - (codes > empty)
        del words[empty]
    return codes.astype(np.int64), edges, words


#: What this process keeps from task to task, by operator and name.
_KEPT: dict[tuple, object] = {}
#: Words that a process keeps have at most so many bytes, which bounds its tables in bytes.
LONGEST = 64


def kept(owner: str, name, make: Callable):
    """What `owner` keeps in this process under `name`. A process keeps things of one operator only; others' go first."""
    _ASKED.add(owner)
    if (owner, name) not in _KEPT:
        if any(o != owner for o, _ in _KEPT):
            _KEPT.clear()
            trim()
        _KEPT[owner, name] = make()
    return _KEPT[owner, name]


#: Operators that have asked for what they keep since the last task began.
_ASKED: set[str] = set()


def trim() -> None:
    """Give back the memory that this process does not use."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def each_batch(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema), whose tasks give back their memory at the end, and what other operators kept.

    Workers get batches of about BATCH_BYTES (a longer row stands alone): the session's setting is lowered to that.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH).rstrip("b")) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # whose free memory trim() gives back
        _ASKED.clear()
        yield from run(batches)
        if not _ASKED:
            _KEPT.clear()  # left by another operator
        trim()

    return df.mapInArrow(task, schema)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every word."""
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w, 7) for w in words], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for every run of k word hashes; empty if there are fewer."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
    return mix(out)


def winnow(h: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of `span` words: its fingerprint (the least k-gram hash in it) and where that k-gram starts.

    The last of several least ones is taken. Fewer words have no window.
    """
    grams = gram_hashes(h, k)
    width = span - k + 1
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, width):
        other = grams[j : j + n]
        lower = other <= best
        best = np.where(lower, other, best)
        at = np.where(lower, np.arange(n) + j, at)
    return best, at


#: Bits of a filter of keys; its size does not depend on the data.
FILTER_BITS = 1 << 23


def filter_slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each key in a filter."""
    keys = mix(keys.view(np.uint64))
    return (keys % np.uint64(bits)).astype(np.int64), ((keys >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


def key_filter(keys: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """A filter of bits / 8 bytes over the first column of keys; see may_hold."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits, bool)
        for batch in batches:
            for slot in filter_slots(batch.column(0).to_numpy(), bits):
                held[slot] = True
        packed = np.packbits(held).view(np.int64)
        full = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(packed[full])], names=["place", "bits"])

    table = gathered(each_batch(keys, fill, "place long, bits long").groupBy("place").agg(F.expr("bit_or(bits)").alias("bits")))  # bits / 64 rows at most
    out = np.zeros(bits // 64, np.int64)
    out[table.column("place").to_numpy()] = table.column("bits").to_numpy()
    return out.tobytes()


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in a filter, whose bits are `table`: true for all that are, and for few others."""
    first, second = filter_slots(keys, len(table))
    return table[first] & table[second]


def filter_bits(raw: bytes) -> np.ndarray:
    """The bits of a filter."""
    return np.unpackbits(np.frombuffer(raw, np.uint8)).astype(bool)
