"""Language-model scoring by prediction by partial matching.

A text is taken as its lower-cased words, each followed by a space, and an end; five spaces stand before it. The model
is a trie of contexts of up to five of the bytes before, across words, counted over all training texts. A symbol is
coded in the longest context seen in training; each context sets aside an escape estimate in proportion to its number
of distinct symbols (method D: half a count of each symbol), and after an escape the symbols of the longer context are
excluded from the shorter one. As contexts nest, every exclusion is fixed when the trie is.

Training texts may come in classes, such as languages. Each then has a trie of its own, and a text has the probability
that the mixture of the tries gives it, each weighed by its share of the training texts. The class of a text that is
scored is never looked at.

No context is left out, however large the tries grow. They are never held whole: what was counted lies in a table that
is dealt out by the last two bytes of contexts, so that a context and all its shorter ones meet (those of up to one
byte, which the alphabet bounds, are sent everywhere). An ending that has too many entries is lengthened by a byte, and
again, until its entries fit; the contexts that are too short for it are sent everywhere, at most 256 entries for each.
So each symbol that some text asks for gets its probability in a group of bounded size. A bounded number of the most
asked ones is known to the tasks that add up texts, the others are joined.

The unigram score beside it counts whole words. The most frequent words, a bounded number, are known to every task;
all others of a document are joined to the table of counts.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import LONGEST, as_bytes, drop_stage, each_batch, gathered, kept, own_shuffles, pick, split_words, stage, text_slices

ORDER = 5
SPACE, END = 0x20, 0x0A
#: Classes with a trie of their own (the most frequent ones; the rest share one).
CLASSES = 8
#: Scores of symbols in their contexts that every task knows (the others are joined), frequent words every task knows,
#: words and entries that a counting task holds, entries of a group of tries.
ENTRIES, FREQUENT, HELD, GROUP = 1 << 20, 1 << 18, 1 << 20, 1 << 20
#: What is counted is a class above, then five bytes of context and a symbol.
_KEY = np.uint64((1 << 48) - 1)


def streams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (five bytes of context, symbol) of all bytes to predict, text by text, and how many each text has."""
    whole = [b"     %s \n" % b" ".join(w) if (w := t.lower().split() if t else []) else b"     \n" for t in texts]
    n = np.array([len(x) for x in whole], np.int64)
    flat = np.frombuffer(b"".join(whole), np.uint8).astype(np.uint64)
    keys = np.zeros(max(0, len(flat) - ORDER), np.uint64)
    for j in range(ORDER + 1):
        keys <<= np.uint64(8)
        keys |= flat[j : len(flat) - ORDER + j]
    # What spans two texts predicts the spaces before one.
    inside = np.ones(len(keys), bool)
    ends = np.cumsum(n)[:-1]
    for j in range(1, ORDER + 1):
        inside[ends - j] = False
    return keys[inside], n - ORDER


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 where they are not there."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class Trie:
    """Log10 probabilities of symbols by context, from sorted keys (order, context, symbol) and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys = keys.astype(np.uint64)
        counts = counts.astype(np.float64)
        of = self.keys >> np.uint64(8)
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        self.nodes = of[heads]
        kinds = np.diff(np.append(heads, len(of)))
        total = np.add.reduceat(counts, heads) if len(heads) else np.zeros(0)
        self.log = np.log10(counts - 0.5)
        self.own = np.repeat(np.arange(len(heads)), kinds)
        self.size = np.log10(total)
        self.escape = np.log10(0.5 * kinds) - self.size
        # What is left of the next shorter context when the symbols of this one are excluded.
        order = self.nodes >> np.uint64(48)
        shorter = self._shorten(self.nodes)
        parent = np.where(order > 0, _find(self.nodes, shorter), -1)
        inside = _find(self.keys, self._shorten(of) << np.uint64(8) | self.keys & np.uint64(255))
        shared = np.bincount(self.own, np.where((inside >= 0) & (of >> np.uint64(48) > 0), counts[inside], 0), len(heads)) if len(heads) else total
        rest_total = np.where(parent >= 0, total[parent] - shared, 0)
        rest_kinds = np.where(parent >= 0, kinds[parent] - kinds, 0)
        some = rest_kinds > 0
        self.rest_size = np.where(some, np.log10(np.maximum(rest_total, 1e-300)), 0.0)
        self.rest_escape = np.where(some, np.log10(np.maximum(0.5 * rest_kinds, 0.5)) - self.rest_size, 0.0)
        zero = _find(self.nodes, np.zeros(1, np.uint64))[0]
        self.uniform = -math.log10(max(1, 256 - (int(kinds[zero]) if zero >= 0 else 0)))

    @staticmethod
    def _shorten(nodes: np.ndarray) -> np.ndarray:
        """Contexts without their first byte."""
        order = nodes >> np.uint64(48)
        less = np.maximum(order, np.uint64(1)) - np.uint64(1)
        return nodes & ((np.uint64(1) << (less * np.uint64(8))) - np.uint64(1)) | less << np.uint64(48)

    def symbols(self, contexts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Log10 probability of each symbol after its context."""
        out = np.zeros(len(symbols))
        todo, left = np.arange(len(symbols)), np.full(len(symbols), -1)
        contexts, symbols = contexts.astype(np.uint64), symbols.astype(np.uint64)
        while len(todo):
            entry = _find(self.keys, contexts[todo] << np.uint64(8) | symbols[todo])
            hit = entry >= 0
            size = np.where(left[todo] >= 0, self.rest_size[left[todo]] if len(self.nodes) else 0, self.size[self.own[entry]] if len(self.keys) else 0)
            out[todo[hit]] += self.log[entry[hit]] - size[hit]
            todo = todo[~hit]
            if not len(todo):
                break
            node = _find(self.nodes, contexts[todo])
            known = node >= 0
            if known.any():
                after = left[todo[known]]
                out[todo[known]] += np.where(after >= 0, self.rest_escape[after], self.escape[node[known]])
                left[todo[known]] = node[known]
            last = contexts[todo] >> np.uint64(48) == 0
            out[todo[last]] += self.uniform
            todo = todo[~last]
            contexts[todo] = self._shorten(contexts[todo])
        return out


def shortened(keys: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the contexts cut to their last `order` bytes, tagged with the order, and the sums of their counts."""
    mask = np.uint64((1 << 8 * (order + 1)) - 1)
    return merged(keys & mask | np.uint64(order << 56), counts)


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n): the counts of every word in all learned texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            row = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return row

        for batch in text_slices(batches, column=0):
            codes, _, words = split_words(pc.ascii_lower(batch.column(0)))
            for w, n in zip(words, np.bincount(codes, minlength=len(words)).tolist()):
                held[w] = held.get(w, 0) + n
            if len(held) > HELD // 4:
                yield flush()
        yield flush()

    return each_batch(texts.where("learned").select("text"), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


_PACKED = "level int, ending long, size long, keys binary, counts binary"


def _pack(keys: np.ndarray, counts: np.ndarray, level: int) -> Iterator[pa.RecordBatch]:
    """Rows for keys and counts, one for each ending of `level` bytes."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    ending = (keys >> np.uint64(8) & np.uint64((1 << 8 * level) - 1)).astype(np.int64)
    order = np.lexsort((keys, ending))
    keys, counts, ending = keys[order], counts[order], ending[order]
    edges = [0, *(np.flatnonzero(np.diff(ending)) + 1).tolist(), len(keys)] if len(keys) else [0]
    parts = list(itertools.pairwise(edges))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([level] * len(parts), pa.int32()), pa.array(ending[edges[:-1]], pa.int64()), pa.array(np.diff(edges).astype(np.int64)),
            pa.array([pack(np.diff(keys[a:b], prepend=np.uint64(0)).tobytes()) for a, b in parts], pa.binary()), pa.array([pack(counts[a:b].astype("<u4").tobytes()) for a, b in parts], pa.binary()),
        ],
        names=["level", "ending", "size", "keys", "counts"],
    )


def _unpack(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    keys = [np.cumsum(np.frombuffer(unpack(x), np.uint64), dtype=np.uint64) for x in batch.column("keys").to_pylist()]
    counts = [np.frombuffer(unpack(x), "<u4") for x in batch.column("counts").to_pylist()]
    return np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64)


def count_keys(texts: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """Packed rows of keys and counts by ending: a key has its class above, asked texts that are not learned the last."""
    other = len(numbers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

        def merge() -> None:
            k, c = merged(np.concatenate(keys), np.concatenate(counts))
            keys[:], counts[:] = [k], [c]

        for batch in text_slices(batches, column=0, most=2_000_000):
            of = np.array([numbers.get(c, other) if learned else other + 1 for c, learned in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())], np.uint64)
            own, n = streams(as_bytes(batch.column(0)))
            found = np.unique(own | np.repeat(of, n) << np.uint64(48), return_counts=True)
            keys.append(found[0])
            counts.append(found[1])
            if sum(map(len, keys)) > 2 * HELD:
                merge()
                if len(keys[0]) > HELD:
                    yield from _pack(keys[0], counts[0], 2)
                    keys[:], counts[:] = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        merge()
        yield from _pack(keys[0], counts[0], 2)

    return each_batch(texts.select("text", "class", "learned"), count, _PACKED)


def short_contexts(packed: DataFrame, order: int, classes: list[int], endings: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of each class in contexts of `order` bytes: all (order 1), or those that are one of the endings."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            keys, n = _unpack(batch)
            for i in classes:
                own = keys >> np.uint64(48) == i
                k, c = shortened(keys[own] & _KEY, n[own], order)
                before = held.get(i, [k[:0], c[:0]])
                held[i] = merged(np.concatenate([before[0], k]), np.concatenate([before[1], c]))
        for i, (k, c) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), i, np.int32)), pa.array(k.view(np.int64)), pa.array(c)], names=["class", "key", "n"])

    chosen = packed if endings is None else packed.where(F.col("ending").isin(endings))
    table = gathered(each_batch(chosen.select("keys", "counts"), count, "class int, key long, n long").groupBy("class", "key").agg(F.sum("n").alias("n")))
    of, keys, n = table.column("class").to_numpy(), table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
    return [merged(keys[of == i], n[of == i]) for i in classes]


def fitting(packed: DataFrame, classes: list[int], group: int = GROUP) -> tuple[DataFrame, list[tuple[np.ndarray, np.ndarray]]]:
    """The packed rows by endings that have at most `group` entries each, and the contexts that are sent everywhere."""
    short = []
    for k, c in short_contexts(packed, 1, classes):
        zero = merged(k & np.uint64(255), c)
        short.append((np.concatenate([zero[0], k]), np.concatenate([zero[1], c])))
    done = None
    for level in range(2, ORDER + 1):
        sizes = packed.groupBy("ending").agg(F.sum("size").alias("size")).where(F.col("size") > group)
        full = sorted(r["ending"] for r in sizes.collect()) if level < ORDER else []  # at most (entries / group)
        part = packed.where(~F.col("ending").isin(full)) if full else packed
        done = part if done is None else done.union(part)
        if not full:
            break
        more = short_contexts(packed, level, classes, full)
        short = [(np.concatenate([a, c]), np.concatenate([b, d])) for (a, b), (c, d) in zip(short, more)]

        def longer(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from _pack(*_unpack(batch.slice(i, 1)), level + 1)

        packed, _ = stage(each_batch(packed.where(F.col("ending").isin(full)), longer, _PACKED), "endings")
    return done, short


def score_keys(packed: DataFrame, classes: list[int], short: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(key, n, s0, s1, ...): every key that texts ask for, how often they do, and its log10 probability in each class.

    What `symbols` needs of a context, its entries and those of all its shorter ones, has the same ending or is in
    `short`; so the tries are built for each ending alone.
    """
    sent = packed.sparkSession.sparkContext.broadcast(short)

    def run(group: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        level, ending = group[0].as_py(), np.uint64(group[1].as_py())
        keys, n = _unpack(rows)
        of, keys = keys >> np.uint64(48), keys & _KEY
        want, asked = merged(keys, n)
        out = []
        for i, (more, counts) in zip(classes, sent.value):
            own = merged(keys[of == i], n[of == i])
            parts = [shortened(*own, order) for order in range(level, ORDER + 1)]
            # Of the contexts that are sent everywhere, those that the ending ends with.
            mask = (np.uint64(1) << (more >> np.uint64(56)) * np.uint64(8)) - np.uint64(1)
            near = (more >> np.uint64(8) & mask) == (ending & mask)
            parts.append((more[near], counts[near]))
            trie = Trie(*merged(*(np.concatenate(x) for x in zip(*parts))))
            out.append(trie.symbols(want >> np.uint64(8) | np.uint64(ORDER << 48), want & np.uint64(255)))
        return pa.table([pa.array(want.view(np.int64)), pa.array(asked), *map(pa.array, out)], names=["key", "n", *(f"s{j}" for j in range(len(classes)))])

    return packed.groupBy("level", "ending").applyInArrow(run, "key long, n long, " + ", ".join(f"s{j} double" for j in range(len(classes))))


class Known:
    """Places of some keys, by a hash table."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            left = self.slots[at] != todo
            todo, at = todo[left], at[left] + 1 & len(self.slots) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; the number of keys for those that are not there."""
        out = np.full(len(keys), len(self.keys), np.int64)
        if not len(self.keys):
            return out
        todo, at = None, self._slot(keys)
        while todo is None or len(todo):
            place = self.slots[at]
            there = place >= 0
            asked = keys if todo is None else keys[todo]
            hit = there & (self.keys[place] == asked)
            if todo is None:
                out[hit] = place[hit]
            else:
                out[todo[hit]] = place[hit]
            left = np.flatnonzero(there & ~hit)
            todo, at = left if todo is None else todo[left], at[left] + 1 & len(self.slots) - 1
        return out


def score(docs: DataFrame, train: DataFrame | Column, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None, entries: int = ENTRIES, frequent: int = FREQUENT, classes: int = CLASSES, group: int = GROUP) -> DataFrame:
    """Score the texts of docs with what is learned from train: texts of a table of their own, or those rows of docs for
    which a column of docs is true. Both tables have the columns id_col and text_col, train also class_col if one is
    given (null is a class like the rare ones); the `classes` most frequent classes have a trie each, the rest share one.

    Returns doc_id, n_tokens (words and one end), n_known (tokens that occur in train), train_tokens, base_score (log10
    probability by smoothed counts of tokens), score (log10 probability by the context tries). Null text counts as
    empty and has its end alone. Every row of docs gives a row, whatever its id; with no training text every token is
    unknown, and the trie is uniform over bytes. Other columns are ignored; an empty table gives no row. `entries`,
    `frequent` and `group` say how much a task holds; results do not depend on them.
    """
    spark = docs.sparkSession
    source = pick(docs, doc_id=id_col, text=text_col)
    label = lambda df: (df[f"`{class_col}`"].cast("string") if class_col else F.lit(None).cast("string")).alias("class")
    if isinstance(train, Column):
        texts = docs.select(docs[f"`{text_col}`"].alias("text"), label(docs), F.coalesce(train, F.lit(False)).alias("learned"))
    else:
        learned = train.select(train[f"`{text_col}`"].alias("text"), label(train), F.lit(True).alias("learned"))
        texts = learned.union(source.select("text", F.lit(None).cast("string"), F.lit(False)))
    sizes = {r["class"]: r["count"] for r in texts.where("learned").groupBy("class").count().orderBy(F.desc("count"), "class").limit(classes + 1).collect()}
    names = [c for c in sizes if c is not None][:classes]
    ends = texts.where("learned").count()
    shares = [sizes[c] for c in names]
    shares.append(ends - sum(shares))
    used = [i for i, n in enumerate(shares) if n] or [0]
    with own_shuffles(spark):
        words, _ = stage(count_words(texts), "words")
        totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        tokens, kinds = totals[0] + ends, totals[1] + (ends > 0)
        packed, path = stage(count_keys(texts, {c: i for i, c in enumerate(names)}), "grams")
        fits, short = fitting(packed, used, group)
        scores, _ = stage(score_keys(fits, used, short), "scores")
        drop_stage(spark, path)
        columns = [f"s{j}" for j in range(len(used))]
        top = gathered(scores.orderBy(F.desc("n"), "key").limit(entries))
        near = gathered(words.where(F.octet_length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(frequent))
    scale = math.log10(tokens + 0.5 * (kinds + 1))
    raw = near.column("word").to_pylist()
    tag, end_base, end_known = uuid.uuid4().hex, math.log10(ends + 0.5) - scale, int(ends > 0)
    sent = spark.sparkContext.broadcast((top.column("key").to_numpy().view(np.uint64), np.stack([np.append(top.column(c).to_numpy(), 0.0) for c in columns]), b"".join(raw), np.array([len(w) for w in raw], np.int64), np.log10(near.column("n").to_numpy() + 0.5) - scale))
    weights = np.log10(np.array([max(shares[i], 1) for i in used], float) / sum(max(shares[i], 1) for i in used))
    numbered = source.select("doc_id", "text", F.xxhash64("text").alias("row"))
    rare = [T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.LongType())), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("asked", T.ArrayType(T.LongType()))]
    schema = T.StructType([source.schema["doc_id"], T.StructField("row", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("base", *columns)), *rare])

    def pairs(doc: np.ndarray, what: np.ndarray, kinds: int, docs: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Offsets by document, distinct things of each document, and how often each is there."""
        both, times = np.unique(doc * max(1, kinds) + what, return_counts=True)
        rows, which = np.divmod(both, max(1, kinds))
        return pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=docs))]), pa.int32()), which, times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, joined, lengths, base_of = sent.value

        def tables() -> tuple[Known, dict[bytes, int]]:
            ends = np.cumsum(lengths)
            return Known(keys), {joined[a:b]: i for i, (a, b) in enumerate(zip((ends - lengths).tolist(), ends.tolist()))}

        known, places = kept("ppm", tag, tables)
        for batch in text_slices(batches, most=1_000_000):
            docs = batch.num_rows
            codes, edges, words = split_words(pc.ascii_lower(batch.column(1)))
            n = np.diff(edges)
            place = np.array([places.get(w, -1) for w in words], np.int64)
            doc = np.repeat(np.arange(docs), n)
            hit = place[codes] >= 0
            base = np.bincount(doc[hit], base_of[place[codes[hit]]], docs).astype(float) + end_base
            found = np.bincount(doc[hit], minlength=docs) + end_known
            offsets, which, times = pairs(doc[~hit], codes[~hit], len(words), docs)
            far = pa.array([words[c] for c in which.tolist()], pa.binary())
            asked, size = streams(as_bytes(batch.column(1)))
            at, first = known.find(asked), np.cumsum(size) - size
            sums = [np.add.reduceat(v[at], first) for v in values]
            missed = np.flatnonzero(at == len(keys))
            rare_keys, code = np.unique(asked[missed], return_inverse=True)
            key_offsets, key_which, key_times = pairs(np.repeat(np.arange(docs), size)[missed], code, len(rare_keys), docs)
            lists = [pa.ListArray.from_arrays(o, x) for o, x in ((offsets, far), (offsets, pa.array(times, pa.int64())), (key_offsets, pa.array(rare_keys[key_which].view(np.int64))), (key_offsets, pa.array(key_times, pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n + 1), pa.array(found), pa.array(base), *map(pa.array, sums), *lists], names=[f.name for f in schema])

    parts, _ = stage(each_batch(numbered, run, schema), "parts")
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    whole = parts.select("doc_id", "row", F.lit(1).cast("long").alias("copies"), "n_tokens", "n_known", "base", *columns)
    of_words = parts.select("doc_id", "row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("doc_id", "row", F.col("x.words").alias("word"), "x.times").join(words, "word", "left")
    of_words = of_words.select("doc_id", "row", zero, zero, F.when(F.col("n") > 0, F.col("times")).otherwise(zero), F.col("times") * (F.log10(F.coalesce("n", zero) + 0.5) - F.lit(scale)), *(none for _ in columns))
    of_keys = parts.select("doc_id", "row", F.explode(F.arrays_zip("keys", "asked")).alias("x")).select("doc_id", "row", F.col("x.keys").alias("key"), "x.asked").join(scores.drop("n"), "key")
    of_keys = of_keys.select("doc_id", "row", zero, zero, zero, none, *(F.col("asked") * F.col(c) for c in columns))
    # Rows that share id and text are added up; each gets its share.
    per_doc = whole.union(of_words).union(of_keys).groupBy("doc_id", "row").agg(*(F.sum(c).alias(c) for c in whole.columns[2:]))
    each = per_doc.select("*", F.array(*(F.col(c) / F.col("copies") + F.lit(float(w)) for c, w in zip(columns, weights))).alias("each"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    best = F.array_max("each")
    model = best + F.log10(F.aggregate("each", F.lit(0.0), lambda total, x: total + F.pow(F.lit(10.0), x - best)))
    return each.select("doc_id", F.expr("n_tokens div copies").alias("n_tokens"), F.expr("n_known div copies").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") / F.col("copies")).alias("base_score"), model.alias("score"))
