"""Language identification by multilingual mixture inference.

A language is a byte trigram model of lower-cased words, whose counts cover all training texts. A document is taken as
words that each come from one of its languages: expectation-maximisation estimates the shares of the languages from
the likelihoods of the words, for the leading language, the leading two, the leading three, and on for as long as the
penalised likelihood grows. The set with the best one is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import each_batch, free_names, gathered, pick, quoted, ranges, split_words, text_slices

#: Slots of trigrams (hashed) and of their two-byte contexts, smoothing, symbols it is spread over.
TRIGRAMS, CONTEXTS, ADD, SYMBOLS = 1 << 17, 1 << 16, 0.2, 64
#: Rounds of expectation-maximisation; sets of up to TRIED languages are compared for every text, larger ones while
#: they are better.
ROUNDS, TRIED = 8, 3
#: A text of more words is taken as its distinct words and their numbers.
MANY = 1 << 19
ADDED = ("lang_pred", "score", "languages")


def letter_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Runs of letters (of Unicode's categories L), lower-cased: codes, edges and words as split_words gives them."""
    return split_words(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"\P{L}+", " "))


def _trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram slots and contexts of all words, and how many each word has."""
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer(b"".join(b"  %s " % w for w in words), np.uint8).astype(np.uint32)
    ends = np.cumsum(lengths + 3)
    at = ranges(ends - lengths - 1, lengths + 1)  # every byte of a word and its end
    context = flat[at - 2] << np.uint32(8) | flat[at - 1]
    gram = context << np.uint32(8) | flat[at]
    return ((gram * np.uint32(2654435761)) >> np.uint32(15)).astype(np.int64), context.astype(np.int64), lengths + 1


class Model:
    """Trigram models of some languages: `names`, and the counts as (language, trigram) and (language, context)."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        self.gram = np.log(counts[:, :TRIGRAMS] + ADD).astype(np.float32).T.copy()
        self.context = np.log(counts[:, TRIGRAMS:] + ADD * SYMBOLS).astype(np.float32).T.copy()

    def words(self, words: list[bytes]) -> np.ndarray:
        """Log-likelihood of every word under every language."""
        out = np.zeros((len(words), len(self.names)), np.float32)
        for a in range(0, len(words), 20_000):
            gram, context, n = _trigrams(words[a : a + 20_000])
            out[a : a + 20_000] = np.add.reduceat(self.gram[gram] - self.context[context], np.cumsum(n) - n, axis=0)
        return out

    def mixtures(self, logs: np.ndarray, edges: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the languages in documents that each have at least one word; rows of logs are words.

        edges[d] is the first word of document d; times says how often each row occurs (once, if none). Languages outside the chosen set have share zero. The second value
        is the penalised log-likelihood for each number of languages, -inf for those that were not tried.
        """
        rows = np.diff(np.append(edges, len(logs)))
        times = np.ones(len(logs), np.float32) if times is None else times.astype(np.float32)
        n = np.add.reduceat(times.astype(np.float64), edges)
        top = logs.max(axis=1, keepdims=True)
        like = np.exp(logs - top)
        base = np.add.reduceat(top[:, 0].astype(np.float64) * times, edges)

        def fit(shares: np.ndarray, rounds: int, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of the documents `who`."""
            chosen = slice(None) if len(who) == len(n) else ranges(edges[who], rows[who])
            own, often = like[chosen], times[chosen]
            first = np.cumsum(rows[who]) - rows[who]
            doc = np.repeat(np.arange(len(who)), rows[who])
            for _ in range(rounds):
                part = own * shares[doc]
                part *= (often / np.maximum(part.sum(axis=1), 1e-30))[:, None]
                shares = np.add.reduceat(part, first, axis=0) / n[who, None].astype(np.float32)
            total = np.add.reduceat(np.log(np.maximum((own * shares[doc]).sum(axis=1), 1e-30).astype(np.float64)) * often, first)
            return shares, base[who] + total

        languages = len(self.names)
        on = np.arange(len(n))
        shares, _ = fit(np.full((len(n), languages), 1 / languages, np.float32), ROUNDS, on)
        order = np.argsort(-shares, axis=1, kind="stable")
        chosen, scores = shares.copy(), np.full((len(n), languages), -np.inf)
        for k in range(1, languages + 1):
            if k > TRIED:
                on = on[scores[on, k - 2] > scores[on, k - 3]]
            if not len(on):
                break
            inside = np.zeros_like(shares[on])
            np.put_along_axis(inside, order[on, :k], 1, axis=1)
            start = inside * np.maximum(shares[on], 1e-3)
            fitted, value = fit(start / start.sum(axis=1, keepdims=True), 0 if k == 1 else ROUNDS // 2, on)
            value = value - 0.5 * k * np.log(n[on] + 1)
            better = value > scores[on, : k - 1].max(axis=1, initial=-np.inf)
            chosen[on[better]] = fitted[better]
            scores[on, k - 1] = value
        return chosen, scores


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count the trigrams of all texts with a language. What is gathered has a fixed size for each language."""
    source = pick(docs, lang=lang_col, text=text_col).where("lang IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in text_slices(batches):
            names = batch.column(0).dictionary_encode()
            of = names.indices.to_numpy()
            codes, edges, words = letter_words(batch.column(1))
            if not words:
                continue
            own = np.repeat(of, np.diff(edges))
            gram, context, n = _trigrams(words)
            for i, lang in enumerate(names.dictionary.to_pylist()):
                weight = np.repeat(np.bincount(codes[own == i], minlength=len(words)).astype(np.float64), n)
                counted = total.setdefault(lang, np.zeros(TRIGRAMS + CONTEXTS))
                counted[:TRIGRAMS] += np.bincount(gram, weight, TRIGRAMS)
                counted[TRIGRAMS:] += np.bincount(context, weight, CONTEXTS)
        for lang, counted in total.items():
            at = np.flatnonzero(counted)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counted[at].astype(np.int64))], names=["lang", "slot", "n"])

    counted = gathered(each_batch(source, count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")))
    langs, slots, n = (counted.column(c) for c in ("lang", "slot", "n"))
    names = sorted(set(langs.to_pylist()))
    place = {name: i for i, name in enumerate(names)}
    counts = np.zeros((len(names), TRIGRAMS + CONTEXTS))
    counts[[place[x] for x in langs.to_pylist()], slots.to_numpy()] = n.to_numpy()
    return Model(names, counts)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The columns of docs as they are, and lang_pred, score (the share of lang_pred in the text), languages (all, with
    shares), whose names get an underscore where docs has such a column (see free_names).

    Only the text is looked at. Null texts, texts without a letter, and all texts if the model has no language are
    `und` with score 0. Repeated rows are answered each. Equal likelihoods go to the language that comes first by name.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # fixed size for each language
    names = free_names(docs.columns, (*ADDED, "__text"))
    both = docs.select(docs[quoted([text_col])[0]].alias(names["__text"]), *quoted(docs.columns))
    share = T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])
    schema = T.StructType([*docs.schema, *(T.StructField(names[a], t) for a, t in zip(ADDED, (T.StringType(), T.DoubleType(), T.ArrayType(share))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in text_slices(batches, column=0, most=1_500_000):
            codes, edges, words = letter_words(batch.column(0))
            n = np.diff(edges)
            langs, scores, lists = ["und"] * len(n), [0.0] * len(n), [[] for _ in n]
            full = np.flatnonzero(n)
            if len(full) and model.names:
                logs, times = model.words(words), None
                if len(n) == 1 and len(codes) > MANY:
                    codes, times = np.unique(codes, return_counts=True)
                    n = np.array([len(codes)])
                first = np.cumsum(n[full]) - n[full]
                shares, _ = model.mixtures(logs[codes], first, times)
                for i, row in zip(full.tolist(), shares.astype(np.float64)):
                    order = np.argsort(-row, kind="stable")
                    langs[i], scores[i] = model.names[order[0]], min(1.0, float(row[order[0]]))
                    lists[i] = [{"lang": model.names[j], "share": float(row[j])} for j in order if row[j] > 0]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(lists, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))], names=[f.name for f in schema])

    return each_batch(both, run, schema)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2):
    """Whether crc32 of the id as text leaves `part`; false for null ids."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % parts == part, F.lit(False))
