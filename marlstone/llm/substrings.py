"""Repeated word sequences, by prefix-partitioned suffix trees.

Every word of a text starts a suffix. A repeat of `span` words is a node of the suffix tree at that depth or deeper, so
trees are cut at `span` words, and only suffixes that can lie below such a node are dealt with: of every window of
`span` words the least 10-gram (by hash) is its anchor, equal windows have equal anchors, and suffixes whose anchor
occurs once in the whole corpus are left out.

The others are split by prefixes of variable length. A prefix of one word whose suffixes fit in memory makes (or
shares) a group; one that has too many is lengthened by a word, and again, until it fits. A group's suffixes are sorted
along their words; the lengths of common prefixes of neighbours are its tree, whose internal nodes at depth `span` are
the repeats. All leaves of such a node but the first are reported, and runs of reported leaves are what is removed.
Words are compared by 16 bits of their hashes each, and whole paths by a digest of 64 bits beside.

Before anything is sent, a task builds the tree of its own suffixes, reports what repeats there and sends the first
leaf of each node alone, so that a passage in a third of all documents reaches its group once for each batch and not
once for each document; prefixes are counted alike.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import as_bytes, drop_stage, each_batch, free_names, gathered, gram_hashes, mix, own_shuffles, pick, quoted, ranges, split_words, stage, text_slices, winnow, word_hashes

SPAN, ANCHOR = 20, 10
#: Suffixes of a group, suffixes that a task sorts at once, and suffixes of a row of runs.
GROUP, HELD, RUN = 400_000, 250_000, 50_000
ADDED = ("n_words", "n_removed", "kept", "spans")


def _windows(texts: pa.Array, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, edges between texts, starts of all windows of `span` words, and where each has its anchor."""
    codes, edges, words = split_words(texts)
    h = word_hashes(words)[codes]
    n = np.diff(edges)
    starts = ranges(edges[:-1], np.maximum(n - span + 1, 0))
    return h, edges, starts, winnow(h, span, min(ANCHOR, span))[1][starts] if len(starts) else starts


def repeated_anchors(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(id, row, hits): for documents that have some, the places of anchors that occur more than once in the corpus."""
    schema = T.StructType([docs.schema["id"], T.StructField("row", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, column=2):
            h, edges, starts, at = _windows(batch.column(2), span)
            at = np.unique(at)
            doc = np.searchsorted(edges, at, side="right") - 1
            keys = gram_hashes(h, min(ANCHOR, span))[at].view(np.int64) if len(at) else at
            has, counts = np.unique(doc, return_counts=True)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(keys, pa.int64()), pa.array((at - edges[doc]).astype(np.int32)))]
            take = pa.array(has, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *lists], names=[f.name for f in schema])

    anchors, path = stage(each_batch(docs.select("id", "row", "text"), run, schema), "anchors")
    # As a table of its own, so that an anchor of very many documents can be joined by several tasks.
    repeated, repeated_path = stage(anchors.select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 1").select("key"), "repeated")
    places = anchors.select("id", "row", F.explode(F.arrays_zip("keys", "places")).alias("x")).select("id", "row", F.col("x.keys").alias("key"), F.col("x.places").alias("place"))
    hits, _ = stage(places.join(repeated, "key", "left_semi").groupBy("id", "row").agg(F.collect_set("place").alias("hits")), "hits")
    for done in (path, repeated_path):
        drop_stage(docs.sparkSession, done)
    return hits


def candidate_runs(docs: DataFrame, hits: DataFrame, span: int = SPAN) -> DataFrame:
    """(id, row, start, n, words): runs of n suffixes whose anchors repeat, and the hashes of their words."""
    hits = hits.select(F.col("id").alias("hit_id"), F.col("row").alias("hit_row"), "hits")
    both = docs.join(hits, docs["id"].eqNullSafe(hits["hit_id"]) & (docs["row"] == hits["hit_row"])).select("id", "row", "text", "hits")
    schema = T.StructType([docs.schema["id"], T.StructField("row", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("words", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, column=2):
            h, edges, starts, at = _windows(batch.column(2), span)
            hit = np.zeros(len(h), bool)
            lists = batch.column(3)
            hit[np.repeat(edges[:-1], lists.value_lengths().to_numpy()) + lists.flatten().to_numpy()] = True
            starts = starts[hit[at]]
            first = np.flatnonzero(np.diff(starts, prepend=-2) != 1)
            n = np.diff(np.append(first, len(starts)))
            pieces = -(-n // RUN)
            part = ranges(np.zeros(len(n), np.int64), pieces)
            begin = np.repeat(starts[first], pieces) + part * RUN
            size = np.minimum(np.repeat(n, pieces) - part * RUN, RUN)
            doc = np.searchsorted(edges, begin, side="right") - 1
            take = pa.array(doc, pa.int64())
            words = [h[a : a + k + span - 1].tobytes() for a, k in zip(begin.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array((begin - edges[doc]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(words, pa.binary())], names=[f.name for f in schema])

    return each_batch(both, run, schema)


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of runs with about `most` suffixes each."""
    held, count = [], 0
    for batch in batches:
        sizes = np.cumsum(batch.column("n").to_numpy())
        edges = [0, *(np.flatnonzero(np.diff(sizes // most)) + 1).tolist(), batch.num_rows]
        for a, b in itertools.pairwise(edges):
            held.append(batch.slice(a, b - a))
            count += int(sizes[b - 1] - (sizes[a - 1] if a else 0)) if b else 0
            if count >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, count = [], 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _suffixes(batch: pa.RecordBatch, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of the runs, where their suffixes start in them, and the run and the start of each suffix."""
    n = batch.column("n").to_numpy().astype(np.int64)
    h = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint64)
    at = ranges(np.cumsum(n + span - 1) - (n + span - 1), n)
    return h, at, np.repeat(np.arange(len(n)), n), ranges(batch.column("start").to_numpy().astype(np.int64), n)


def _paths(h: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """The paths of suffixes: `span` words of 16 bits, then a digest of them all; in the order of the words."""
    out = np.zeros((len(at), 2 * span + 8), np.uint8)
    if len(at):
        words = np.lib.stride_tricks.sliding_window_view((h >> np.uint64(48)).astype(">u2"), span)[at]
        out[:, : 2 * span] = np.ascontiguousarray(words).view(np.uint8).reshape(len(at), -1)
        out[:, 2 * span :] = gram_hashes(h, span)[at].astype(">u8").view(np.uint8).reshape(len(at), -1)
    return out.reshape(-1).view(f"S{2 * span + 8}")


def common_words(paths: np.ndarray, span: int) -> np.ndarray:
    """Of sorted paths, how many words each shares with the one before; whole paths share `span` only if digests agree."""
    flat = paths.view(np.uint8).reshape(len(paths), -1)
    differ = flat[1:] != flat[:-1]
    some = differ.any(axis=1)
    return np.concatenate([[0], np.where(some, np.minimum(differ.argmax(axis=1) // 2, span - 1), span)]).astype(np.int64)


def deep_nodes(paths: np.ndarray, doc: np.ndarray, start: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the tree of the suffixes, the leaves that follow another leaf of their node at depth `span`, and of every
    path the first leaf; leaves come in the order of doc and start, and equal ones are one."""
    if not len(paths):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(paths, kind="stable")
    head = common_words(paths[order], span) < span
    node = np.cumsum(head) - 1
    order = order[np.lexsort((start[order], doc[order], node))]
    first = order[head]
    lead = first[node]
    return order[(doc[order] != doc[lead]) | (start[order] != start[lead])], first


def _in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key is in the sorted table."""
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys if len(table) else np.zeros(len(keys), bool)


def full_prefixes(runs: DataFrame, span: int = SPAN, group: int = GROUP) -> list[np.ndarray]:
    """Hashes of the prefixes of one word, two words, ... that have more than `group` suffixes and so get longer.

    At most (suffixes / group) of each length. Equal suffixes of a batch count once, as they are sent once.
    """
    out: list[np.ndarray] = []
    while len(out) < span - 1:
        sent = runs.sparkSession.sparkContext.broadcast(out[-1] if out else None)
        level = len(out) + 1

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _held(batches, HELD):
                h, at, _, _ = _suffixes(batch, span)
                at = at[np.unique(gram_hashes(h, span)[at], return_index=True)[1]]
                if sent.value is not None:
                    at = at[_in(sent.value, gram_hashes(h, level - 1)[at])]
                prefixes, n = np.unique(gram_hashes(h, level)[at], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(prefixes.view(np.int64)), pa.array(n)], names=["prefix", "n"])

        counted = each_batch(runs.select("start", "n", "words"), count, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
        full = gathered(counted.where(F.col("n") > group).select("prefix")).column("prefix").to_numpy().view(np.uint64)
        if not len(full):
            break
        out.append(np.sort(full))
    return out


def _groups(h: np.ndarray, at: np.ndarray, full: list[np.ndarray], groups: int) -> np.ndarray:
    """The group of every suffix: that of its shortest prefix that is not too full."""
    out = np.full(len(at), -1, np.int64)
    for level in range(1, len(full) + 2):
        prefix = gram_hashes(h, level)[at]
        fits = ~_in(full[level - 1], prefix) if level <= len(full) else np.ones(len(at), bool)
        out = np.where((out < 0) & fits, (mix(prefix + np.uint64(level)) % np.uint64(groups)).astype(np.int64), out)
    return out


def _dense_order(ids: pa.Array, rows: pa.Array) -> np.ndarray:
    """Place of every document in the order of (id, row), nulls first; equal ones share a place."""
    table = pa.table({"id": ids, "row": rows})
    order = pc.sort_indices(table, sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_start").to_numpy()
    ids, rows = ids.take(pa.array(order)), rows.take(pa.array(order))
    if len(order) < 2:
        return np.zeros(len(order), np.int64)
    a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
    equal = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))
    equal &= pc.equal(rows.slice(1), rows.slice(0, len(rows) - 1)).to_numpy(zero_copy_only=False)
    out = np.zeros(len(order), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(~equal)])
    return out


def _flat(table: pa.Table, column: str) -> pa.Array:
    """The items of a list column, one after the other."""
    flat = pc.list_flatten(table.column(column).combine_chunks())
    return pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat


def repeated_starts(docs: DataFrame, span: int = SPAN, group: int = GROUP) -> DataFrame:
    """(id, row, starts): for documents that have some, the starts of `span`-word windows that occur earlier.

    docs has id, row (tells apart documents that share an id) and text. starts holds packed 32-bit integers.
    """
    spark = docs.sparkSession
    hits = repeated_anchors(docs, span)
    runs, _ = stage(candidate_runs(docs, hits, span), "runs")
    full = full_prefixes(runs, span, group)
    total = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups, shards = max(1, -(-2 * total // group)), max(1, -(-total // (4 * group)))
    sent = spark.sparkContext.broadcast(full)
    id_field = docs.schema["id"]
    lists = [T.StructField("ids", T.ArrayType(id_field.dataType)), T.StructField("rows", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField("group", T.LongType()), T.StructField("repeat", T.BooleanType()), *lists, *(T.StructField(c, T.BinaryType()) for c in ("counts", "starts", "paths"))])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _held(batches, HELD):
            h, at, run, start = _suffixes(batch, span)
            names, tags = batch.column("id"), batch.column("row")
            doc = _dense_order(names, tags)
            of = np.zeros(len(doc), np.int64)
            of[doc[::-1]] = np.arange(len(doc))[::-1]  # a run of each document
            doc = doc[run]
            paths = _paths(h, at, span)
            repeat, first = deep_nodes(paths, doc, start, span)
            own = _groups(h, at, sent.value, groups)
            # What is known to repeat needs no tree and goes to any group, so that a frequent passage does not fill its own.
            known = np.full(len(own), crc32(f"{names[0]}/{tags[0]}/{start[0]}".encode()) % groups)
            out: list[tuple] = []
            for chosen, to, told in ((first, own, False), (repeat, known, True)):
                order = chosen[np.lexsort((start[chosen], doc[chosen], to[chosen]))]
                edges = [0, *(np.flatnonzero(np.diff(to[order])) + 1).tolist(), len(order)] if len(order) else [0]
                for a, b in itertools.pairwise(edges):
                    part = order[a:b]
                    which, n = np.unique(doc[part], return_counts=True)
                    take = pa.array(of[which])
                    out.append((int(to[part[0]]), told, names.take(take), tags.take(take), n.astype("<u4").tobytes(), start[part].astype("<u4").tobytes(), b"" if told else paths[part].tobytes()))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x[2]) for x in out])]), pa.int32())
            packed = [pa.ListArray.from_arrays(offsets, pa.concat_arrays([x[i] for x in out])) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out]), *packed, *(pa.array([x[i] for x in out], pa.binary()) for i in (4, 5, 6))], names=[f.name for f in schema])

    def subtree(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        read = lambda name: [np.frombuffer(x, "<u4") for x in table.column(name).to_pylist()]
        names, tags = _flat(table, "ids"), _flat(table, "rows")
        place = _dense_order(names, tags)
        counts, starts = read("counts"), read("starts")
        n_docs = np.array([len(x) for x in counts], np.int64)
        doc = np.repeat(ranges(np.cumsum(n_docs) - n_docs, n_docs), np.concatenate(counts))
        start = np.concatenate(starts).astype(np.int64)
        known = np.repeat(table.column("repeat").to_numpy(), [len(x) for x in starts])
        fresh = np.flatnonzero(~known)
        paths = np.frombuffer(b"".join(table.column("paths").to_pylist()), f"S{2 * span + 8}")
        repeat, _ = deep_nodes(paths, place[doc[fresh]], start[fresh], span)
        found = np.concatenate([np.flatnonzero(known), fresh[repeat]])
        found = found[np.lexsort((start[found], doc[found]))]
        which, first = np.unique(doc[found], return_index=True)
        packed = start[found].astype("<u4")
        parts = [packed[x:y].tobytes() for x, y in itertools.pairwise([*first.tolist(), len(found)])]
        names, tags = names.take(pa.array(which, pa.int64())), tags.take(pa.array(which, pa.int64()))
        shard = np.array([crc32(f"{i}/{r}".encode()) % shards for i, r in zip(names.to_pylist(), tags.to_pylist())], np.int64)
        order = np.argsort(shard, kind="stable")
        told, edges = np.unique(shard[order], return_index=True)
        edges = np.append(edges, len(order))
        lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), x.take(pa.array(order))) for x in (names, tags)]
        parts = [[parts[i] for i in order[x:y]] for x, y in itertools.pairwise(edges.tolist())]
        return pa.table({"shard": pa.array(told, pa.int64()), "ids": lists[0], "rows": lists[1], "counts": pa.array([np.array([len(x) // 4 for x in p], "<u4").tobytes() for p in parts], pa.binary()), "starts": pa.array([b"".join(p) for p in parts], pa.binary())})

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names, tags = _flat(table, "ids"), _flat(table, "rows")
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()]).astype(np.int64)
        starts = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("starts").to_pylist()])
        place = _dense_order(names, tags)
        _, one = np.unique(place, return_index=True)
        order = np.argsort(np.repeat(place, counts), kind="stable")
        starts, sizes = starts[order], np.bincount(place, counts).astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        return pa.table({"id": names.take(pa.array(one)), "row": tags.take(pa.array(one)), "starts": pa.array([starts[x:y].tobytes() for x, y in itertools.pairwise(edges)], pa.binary())})

    # Answers are packed by shards of documents, so that their rows do not depend on how many groups a document is in.
    answer = T.StructType([T.StructField("shard", T.LongType()), *lists, T.StructField("counts", T.BinaryType()), T.StructField("starts", T.BinaryType())])
    found = each_batch(runs, send, schema).groupBy("group").applyInArrow(subtree, answer)
    return found.groupBy("shard").applyInArrow(gather, T.StructType([id_field, T.StructField("row", T.LongType()), T.StructField("starts", T.BinaryType())]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, group: int = GROUP) -> DataFrame:
    """The columns of docs as they are, and n_words, n_removed, kept (the words that stay, joined by a space), spans,
    whose names get an underscore where docs has such a column (see free_names).

    A word goes if a window of `span` words covers it whose words also start earlier: in a document with a smaller
    id, or earlier in the same one. spans are the maximal runs of words that went, [start, end); two repeats side by
    side make one run. Null text has no words and kept is empty. Null ids come before all others. Rows that share id
    and text are the same document and all get its result; rows that share the id alone come in the order of a hash of
    their texts. An empty table gives no row. Words are compared as they are.
    """
    spark = docs.sparkSession
    named = pick(docs, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("row"), "text")
    with own_shuffles(spark):
        starts, _ = stage(repeated_starts(named, span, group), "repeats")
    names = free_names(docs.columns, (*ADDED, "__text", "__id", "__row", "__starts"))
    text, own_id = (docs[quoted([c])[0]] for c in (text_col, id_col))
    per_doc = starts.select(*(F.col(c).alias(names[f"__{c}"]) for c in ("id", "row", "starts")))
    both = docs.join(per_doc, own_id.eqNullSafe(per_doc[names["__id"]]) & (F.xxhash64(text) == per_doc[names["__row"]]), "left")
    both = both.select(text.alias(names["__text"]), per_doc[names["__starts"]], *(docs[c] for c in quoted(docs.columns)))
    span_type = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*docs.schema, *(T.StructField(names[a], t) for a, t in zip(ADDED, (T.LongType(), T.LongType(), T.StringType(), span_type)))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, column=0):
            counts, gone, kept, spans = [], [], [], []
            for text, packed in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                words = text.split() if text else []
                counts.append(len(words))
                if not packed:
                    gone.append(0)
                    kept.append(b" ".join(words).decode())
                    spans.append([])
                    continue
                at = np.frombuffer(packed, "<u4").astype(np.int64)
                change = np.bincount(at, minlength=len(words) + 1)[: len(words) + 1] - np.bincount(at + span, minlength=len(words) + 1)[: len(words) + 1]
                removed = np.cumsum(change)[: len(words)] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], removed.astype(np.int8), [0]])))
                gone.append(int(removed.sum()))
                kept.append(b" ".join(itertools.compress(words, (~removed).tolist())).decode())
                spans.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=[f.name for f in schema])

    return each_batch(both, apply, schema)
