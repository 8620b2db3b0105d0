"""Benchmark decontamination by winnowing.

Of each window of `span` words the least hash among its k-grams is selected; consecutive windows mostly select the same
one, and it is kept once, with its place. Two texts that share `span` consecutive words select the same k-gram there.
Selected fingerprints of documents and items are joined, and every hit is extended to both sides, to all windows that
hold the k-gram, whose words are compared with those of the items' windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import FILTER_BITS, as_bytes, each_batch, filter_bits, gram_hashes, key_filter, may_hold, mix, pick, ranges, split_words, stage, text_slices, winnow, word_hashes

#: ASCII bytes other than digits and letters end a word; capital letters count as small ones.
_TABLE = bytes(32 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
SPAN, GRAM = 10, 8


def normal_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of digits, letters and non-ASCII characters."""
    return text.translate(_TABLE).split() if text else []


def _short_key(h: np.ndarray, n: int) -> np.ndarray:
    """Keys of all runs of n words, for items shorter than a window; n keeps lengths apart."""
    return mix(gram_hashes(h, n) + np.uint64(n))


def item_windows(items: DataFrame, item_col: str, text_col: str, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """One row per window of an item: item, key (its fingerprint), window (its words, space-joined), size (in words)."""
    source = pick(items, item=item_col, text=text_col)
    schema = T.StructType([source.schema["item"], T.StructField("key", T.LongType()), T.StructField("window", T.StringType()), T.StructField("size", T.IntegerType())])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows, keys, texts, sizes = [], [], [], []
            for row, text in enumerate(as_bytes(batch.column(1))):
                words = normal_words(text)
                h = word_hashes(words)
                if 0 < len(words) < span:
                    found, size = _short_key(h, len(words)), len(words)
                else:
                    (found, _), size = winnow(h, span, k), span
                for start, key in enumerate(found.view(np.int64).tolist()):
                    rows.append(row)
                    keys.append(key)
                    texts.append(b" ".join(words[start : start + size]).decode())
                    sizes.append(size)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.int64()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32())], names=[f.name for f in schema])

    return each_batch(source, windows, schema)


def contamination(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = GRAM, filter_size: int = FILTER_BITS) -> DataFrame:
    """Which words of which documents lie in windows of benchmark items.

    Returns doc_id, row (a hash of the text), n_words, n_hit (words in any occurrence of a window), n_items (items with occurring windows),
    items (their ids as sorted strings), spans (merged hit spans, [start, end) in words). An item's windows are its
    runs of `span` words, or the whole item if it is shorter. Null and empty texts have no words, items without words
    no window. Rows of docs that share id and text count as one; those that share the id alone are kept apart. Other
    columns are ignored, and an empty table of either kind is allowed.
    """
    spark = docs.sparkSession
    windows = item_windows(items, item_col, item_text_col, span, k).distinct()
    short = sorted(r["size"] for r in windows.where(F.col("size") < span).select("size").distinct().collect())  # fewer than span
    sent = spark.sparkContext.broadcast(key_filter(windows.select("key"), filter_size))
    source = pick(docs, doc_id=doc_col, text=text_col).select("doc_id", "text", F.xxhash64("text").alias("row"))
    schema = T.StructType([source.schema["doc_id"], *(T.StructField(n, t) for n, t in (("row", T.LongType()), ("n_words", T.LongType()), ("key", T.LongType()), ("around", T.ArrayType(T.StringType())), ("size", T.IntegerType()), ("start", T.IntegerType())))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = filter_bits(sent.value)
        for batch in text_slices(batches):
            rows, counts, keys, around, sizes, starts = [], [], [], [], [], []
            texts = as_bytes(batch.column(1))
            split = pa.array([t.translate(_TABLE) if t else b"" for t in texts], pa.binary()).cast(pa.string())
            codes, edges, distinct = split_words(split)
            h = word_hashes(distinct)[codes]
            n = np.diff(edges)
            windows = ranges(edges[:-1], np.maximum(n - span + 1, 0))
            # The selected k-grams, each once; then runs as long as an item that is shorter than a window.
            found = []
            if len(windows):
                at = np.unique(winnow(h, span, k)[1][windows])
                found.append((at, gram_hashes(h, k)[at], span))
            for size in short:
                at = ranges(edges[:-1], np.maximum(n - size + 1, 0))
                found.append((at, _short_key(h, size)[at], size) if len(at) else (at, at.astype(np.uint64), size))
            for at, key, size in found:
                some = may_hold(table, key)
                doc = np.searchsorted(edges, at[some], side="right") - 1
                more = span - k if size == span else 0
                for d, i, x in zip(doc.tolist(), at[some].tolist(), key[some].view(np.int64).tolist()):
                    a, b = max(int(edges[d]), i - more), min(int(edges[d + 1]), i + (span if size == span else size))
                    rows.append(d)
                    keys.append(x)
                    around.append([distinct[c].decode() for c in codes[a:b].tolist()])
                    sizes.append(size)
                    starts.append(a - int(edges[d]))
            # One row for the document itself, with a key of its own and no word.
            own = h[np.minimum(edges[:-1], max(0, len(h) - 1))].view(np.int64) if len(h) else np.arange(len(n))
            whole = len(n)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).take(pa.array([*range(whole), *rows], pa.int64())) for i in (0, 2)), pa.array([*n.tolist(), *n[rows].tolist()], pa.int64()), pa.array([*own.tolist(), *keys], pa.int64()),
                    pa.array([[]] * whole + around, pa.list_(pa.string())), pa.array([0] * whole + sizes, pa.int32()), pa.array([-1] * whole + starts, pa.int32()),
                ],
                names=[f.name for f in schema],
            )

    # Fingerprints meet; what did not meet an item's is gone but for the documents' own rows.
    met = each_batch(source, scan, schema).join(windows.select("key", F.lit(True).alias("met")).distinct(), "key", "left").where("met OR start < 0")
    # A hit is extended to all windows around it.
    places = F.sequence(F.lit(0), F.greatest(F.size("around") - F.col("size"), F.lit(0)))
    extended = met.select("doc_id", "row", "n_words", "key", F.when(F.col("start") < 0, F.array(F.lit(0))).otherwise(places).alias("places"), "around", "size", "start")
    extended = extended.select("doc_id", "row", "n_words", "key", "around", "size", F.col("start").alias("first"), F.explode("places").alias("place"))
    text = F.array_join(F.slice("around", F.col("place") + 1, F.greatest("size", F.lit(1))), " ")
    found = extended.where("first < 0 OR size <= size(around)").select("doc_id", "row", "n_words", "key", text.alias("window"), F.when(F.col("first") < 0, -1).otherwise(F.col("first") + F.col("place")).alias("start"))
    # Windows of the same set of items share a set number, so that a document carries sets and not repeated lists.
    numbered = windows.groupBy("key", "window", "size").agg(F.struct(F.count(F.lit(1)).alias("n"), *(F.sum((F.xxhash64("item", F.lit(seed)) % (1 << 40))).alias(f"h{seed}") for seed in (1, 2, 3))).alias("set"))
    members = windows.join(numbered, ["key", "window", "size"]).select("set", "item").distinct()
    # Fingerprints meet, and the windows that chose them are compared word for word.
    hits = found.join(numbered, ["key", "window"], "left").where("start < 0 OR size IS NOT NULL")
    hit = F.col("start") >= 0
    by_doc, _ = stage(
        hits.groupBy("doc_id", "row").agg(F.first("n_words").alias("n_words"), F.array_sort(F.collect_set(F.when(hit, F.struct("start", (F.col("start") + F.col("size")).alias("end"))))).alias("found"), F.collect_set(F.when(hit, F.col("set"))).alias("sets")),
        "contaminated",
    )
    none = "cast(array() as array<struct<start:int,end:int>>)"
    merged = F.aggregate(
        "found",
        F.expr(none),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["start"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(done, F.lit(-1))["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    dirty = by_doc.where(F.size("found") > 0).select("doc_id", "row", "sets")
    named = dirty.select("doc_id", "row", F.explode("sets").alias("set")).join(members, "set").groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    spans = by_doc.withColumn("spans", merged).alias("d").join(named.alias("n"), F.col("d.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("d.row") == F.col("n.row")), "left")
    items_or_none = F.coalesce(F.col("n.items"), F.expr("cast(array() as array<string>)"))
    return spans.select("d.doc_id", "d.row", "d.n_words", F.aggregate("d.spans", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"]).alias("n_hit"), F.size(items_or_none).cast("long").alias("n_items"), items_or_none.alias("items"), "d.spans")
