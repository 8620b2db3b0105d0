"""A quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the counts
of their vote patterns (a number fixed by the labellers) estimates how each one votes on good and on bad documents,
and so the probability that a document of each pattern is good. Those probabilities train a linear scorer on hashed
words, word shapes and repetitions, which scores every document. A second set of labellers does the same for insults:
two look at a fixed list of words, two are linear models, one of words and one of their beginnings, fitted on a bounded
sample of rows with labels, so that insults that no list holds are voted on as well. The probabilities of their
patterns, estimated from all rows and anchored by those with labels, train a second scorer, whose answer counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import as_bytes, pick, text_slices

#: Weights of the scorer, and the most rows it is trained on (chosen by a hash of their text).
BUCKETS, TRAIN_ROWS = 1 << 16, 10_000
EPOCHS, RATE = 150, 0.5
#: Features of insults: buckets of words, buckets of beginnings, the constant, and the number of listed words.
CONSTANT, LISTED, INSULT_SIZE = 2 * BUCKETS, 2 * BUCKETS + 1, 2 * BUCKETS + 2
#: A feature of insults counts from this many rows of the sample on, and its weight decays (chosen on a split of the training labels).
INSULT_LEAST, INSULT_DECAY = 10, 1e-3
#: The most rows with labels that the guides are fitted on, and how sure a guide must be to vote.
LABEL_ROWS, SURE = 4_000, 0.7
#: Texts are dealt to folds by a hash; guides fitted on the others judge a fold, so that no guide judges what it has seen.
FOLDS = 2
KNOWN = 300_000

FUNCTION_WORDS = frozenset(
    """the of and to in a is that it for on was be with as this by are at from or an not but have
    der die und das ein eine nicht mit von den des im zu ist auf sich dem
    le la les et des en un une du que qui dans pour par sur au est pas
    el los las y por con para se del al una su es lo como""".split()
)
INSULTS = frozenset(
    """idiot idiots moron morons stupid clown clowns loser losers pathetic worthless disgusting scum trash filth filthy
    dumb imbecile imbeciles bastard vermin retard freak pig
    dumm blöd trottel abschaum wertlos stupide imbécile abruti minable ordure estúpido imbécil basura inútil asqueroso""".split()
)


_MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
#: Kinds of bytes: capital letters, other letters and all beyond ASCII, digits; marks stand for themselves.
_KINDS = np.array([0x58 if 0x41 <= c <= 0x5A else 0x78 if c >= 0x80 or chr(c).isalpha() else 0x30 if 0x30 <= c <= 0x39 else c for c in range(256)], np.uint8)
_IS_MARK, _IS_END = (np.isin(np.arange(256), list(marks)) for marks in (_MARKS, b".,;:!?"))
_FUNCTION, _INSULTS = (frozenset(w.encode() for w in words) for words in (FUNCTION_WORDS, INSULTS))
#: Multipliers of the hash of a word's shape, one for each of its first places.
_PLACES = np.random.default_rng(12).integers(1, 1 << 63, 12, np.uint64) | np.uint64(1)

#: What the labellers and the scorers look at: listed words, marks and letters, then buckets.
FIELDS = ("function", "stop", "insult", "capitals", "marks", "letters", "size", "word", "beginning", "shape")
WORD, BEGINNING, SHAPE = range(7, 10)


def _beginning(core: bytes) -> bytes:
    """The first five characters."""
    return core[:5] if core[:20].isascii() else core[:20].decode("utf-8", "ignore")[:5].encode()


def tell(words: list[bytes]) -> np.ndarray:
    """A row of FIELDS for each word: of its bytes, of the word without marks, and of its shape, with runs as one."""
    size = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(size) - size
    text = np.frombuffer(b"".join(words), np.uint8)
    count = lambda flags: np.add.reduceat(flags.astype(np.int32), starts)
    kinds = _KINDS[text]
    marks, digits = count(_IS_MARK[text]), count(kinds == 0x30)
    cores = [w.lower().strip(b".,;:!?\"'()[]|#$%&*") for w in words]
    listed = [np.array([c in known for c in cores]) for known in (_FUNCTION, _INSULTS)]
    word, beginning = (np.array([crc32(x) for x in part], np.int64) % BUCKETS for part in (cores, map(_beginning, cores)))
    first = np.ones(len(text), bool)
    first[1:] = kinds[1:] != kinds[:-1]
    first[starts] = True
    runs = count(first)
    place = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    held = np.where(place < 12, kinds[first].astype(np.uint64) * _PLACES[np.minimum(place, 11)], np.uint64(0))
    shape = np.add.reduceat(held, np.cumsum(runs) - runs) >> np.uint64(48)
    return np.stack([listed[0], _IS_END[text[starts + size - 1]], listed[1], count(kinds == 0x58), marks, size - marks - digits, size, word, BUCKETS + beginning, shape % np.uint64(BUCKETS)], axis=1).astype(np.int32)


class Words(dict):
    """Codes of words, and a row of `table` for each code: what is told of the word."""

    def __init__(self):
        super().__init__()
        self.table = np.zeros((0, len(FIELDS)), np.int32)
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code

    def code(self, split: list[list[bytes]]) -> np.ndarray:
        """Codes of all words. Words beyond the first KNOWN are forgotten with the next call."""
        if len(self) > KNOWN:
            for w in [w for w, c in zip(reversed(self), range(len(self) - KNOWN))]:
                del self[w]
            self.table = self.table[:KNOWN]
        self.new = []
        codes = np.array([c for s in split for c in map(self.__getitem__, s)], np.int64)
        if self.new:
            self.table = np.concatenate([self.table, tell(self.new)])
        return codes


#: This process's words.
_WORDS = Words()


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """1 good, 2 bad, 0 neither."""
    return np.where(bad, 2, np.where(good, 1, 0))


def _split(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, their number, and the text of each word."""
    split = [t.split() if t else [] for t in texts]
    n = np.array([len(s) for s in split], np.int64)
    return split, n, np.repeat(np.arange(len(n)), n)


def _repeats(codes: np.ndarray, doc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Share of words that equal the word before."""
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    return np.bincount(doc[again], minlength=len(n)) / np.maximum(n, 1)


def _same_lines(texts: list[bytes | None]) -> np.ndarray:
    """Share of lines that occur before."""
    lines = [[x for x in t.split(b"\n") if x.strip()] if t else [] for t in texts]
    return np.array([1 - len(set(x)) / len(x) if x else 0.0 for x in lines])


class Seen:
    """Words of texts, by their codes."""

    def __init__(self, texts: list[bytes | None]):
        split, self.n, self.doc = _split(texts)
        self.codes = _WORDS.code(split)
        self.table, self.size = _WORDS.table, max(1, len(_WORDS))
        #: Distinct words of each text.
        self.own_doc, self.own = np.divmod(np.unique(self.doc * self.size + self.codes), self.size)
        self.repeats, self.same_lines = _repeats(self.codes, self.doc, self.n), _same_lines(texts)

    def spelled(self) -> np.ndarray:
        """Buckets of distinct words, and of their beginnings."""
        return self.table[self.own, WORD : BEGINNING + 1]

    def linear(self, weights: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
        """Logistic answer of the weights of insult_features; a row of weights for each fold if there are folds."""
        fold = np.zeros(len(self.n), np.int64) if fold is None else fold
        weights, found = np.atleast_2d(weights), self.spelled()
        listed, own = self.table[self.own, FIELDS.index("insult")], fold[self.own_doc]
        raw = np.bincount(self.own_doc, weights[own, found[:, 0]] + weights[own, found[:, 1]] + weights[own, LISTED] * listed, len(self.n)) + weights[fold, CONSTANT]
        return 1 / (1 + np.exp(-np.clip(raw, -50, 50)))


def votes(seen: Seen, guides: np.ndarray | None = None, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Votes of the labellers of quality and of insults, a row for each text. Without guides, theirs are empty."""
    n, doc, codes = seen.n, seen.doc, seen.codes
    total = {f: np.bincount(doc, seen.table[codes, i], len(n)) for i, f in enumerate(FIELDS[:WORD])}
    some = np.maximum(n, 1)
    repeats, same_lines = seen.repeats, seen.same_lines
    distinct = np.bincount(seen.own_doc, minlength=len(n)) / some
    marks = total["marks"] / np.maximum(total["size"], 1)
    capitals = total["capitals"] / np.maximum(total["letters"], 1)
    function, stop = total["function"] / some, total["stop"] / some
    long = n >= 20
    quality = np.stack(
        [
            _vote((marks < 0.05) & (n > 0), marks > 0.09),
            _vote((capitals < 0.06) & (n > 0), capitals > 0.25),
            _vote((repeats < 0.02) & long, (repeats > 0.1) & long),
            _vote((distinct > 0.55) & long, (distinct < 0.3) & long & (n < 2000)),
            _vote((same_lines < 0.15) & (n > 0), same_lines > 0.4),
            _vote((function > 0.08) & (function < 0.42), (function < 0.03) & long | (function > 0.5)),
            _vote((stop > 0.04) & (stop < 0.4), (stop < 0.02) & long),
            _vote(n >= 50, n < 3),
        ],
        axis=1,
    )
    hits = total["insult"]
    guided = [np.zeros(len(n), np.int64)] * 2 if guides is None else [_vote((p < 1 - SURE) & (n > 0), p > SURE) for p in (seen.linear(own, fold) for own in guides)]
    return quality, np.stack([_vote(np.zeros(len(n), bool), hits >= 1), _vote(np.zeros(len(n), bool), hits / some > 0.01), *guided], axis=1)


def features(seen: Seen) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of the scorer of quality as rows, buckets and values."""
    n, doc = seen.n, seen.doc
    share = 1 / np.maximum(n, 1)[doc]
    extra = np.tile(np.array([0, 1, 2]), len(n))  # the first buckets also hold repeats, equal lines and the constant
    own = np.stack([seen.repeats, seen.same_lines, np.ones(len(n))], axis=1).reshape(-1)
    return np.concatenate([doc, doc, np.repeat(np.arange(len(n)), 3)]), np.concatenate([seen.table[seen.codes, WORD], seen.table[seen.codes, SHAPE], extra]), np.concatenate([share, share, own])


def insult_features(seen: Seen) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the scorer of insults: distinct words, their beginnings, those on the list, and the constant."""
    found = seen.spelled().astype(np.int64)
    every, listed = np.arange(len(seen.n)), seen.own_doc[seen.table[seen.own, FIELDS.index("insult")] > 0]
    rows = np.concatenate([seen.own_doc, seen.own_doc, listed, every])
    return rows, np.concatenate([found[:, 0], found[:, 1], np.full(len(listed), LISTED), np.full(len(every), CONSTANT)]), np.ones(len(rows))


def pattern(votes: np.ndarray) -> np.ndarray:
    """Votes as one number in base three."""
    return votes @ 3 ** np.arange(votes.shape[1])


def estimate(counts: dict[int, int], labellers: int, prior: float = 0.85, rounds: int = 200, known: np.ndarray | None = None, groups: tuple | None = None) -> np.ndarray:
    """Probability of "good" for every vote pattern, by expectation-maximisation over the counts of the patterns.

    Labellers are taken to vote independently given the class, each with its own accuracy and readiness to vote on
    either class. The start takes every labeller for better than chance, which fixes the meaning of the classes.
    Labellers that see different things break independence: `groups` gives bad documents a kind for each group, which
    that group sees at the start and the others do not. known counts patterns of good (row 0) and bad rows whose class
    is given; they stay in their class.
    """
    groups = groups or (range(labellers),)
    codes = np.arange(3**labellers)
    votes = codes[:, None] // 3 ** np.arange(labellers) % 3
    weight = np.zeros(len(codes))
    for code, n in counts.items():
        weight[code] = n
    good, bad, blind = (0.2, 0.7, 0.1), (0.2, 0.1, 0.7), (0.45, 0.45, 0.1)
    chance = np.log(np.array([[good] * labellers, *([bad if i in g else blind for i in range(labellers)] for g in groups)]))  # class, labeller, vote
    share = np.array([prior, *[(1 - prior) / len(groups)] * len(groups)])
    for _ in range(rounds):
        logs = np.log(share)[:, None] + sum(chance[:, i, votes[:, i]] for i in range(labellers))
        logs -= logs.max(axis=0)
        post = np.exp(logs) / np.exp(logs).sum(axis=0)
        if not weight.sum():
            break
        part = post * weight
        if known is not None:
            kind = np.exp(logs[1:] - logs[1:].max(axis=0))
            part = part + np.concatenate([known[:1], kind / kind.sum(axis=0) * known[1]])
        new = np.stack([[[part[k, votes[:, i] == v].sum() for v in range(3)] for i in range(labellers)] for k in range(len(share))]) + np.array([0.2, 0.4, 0.4])
        chance = np.log(new / new.sum(axis=2, keepdims=True))
        shares = part.sum(axis=1) + 1
        share = shares / shares.sum()
    return post[0]


def train(rows: np.ndarray, buckets: np.ndarray, values: np.ndarray, target: np.ndarray, size: int = BUCKETS, decay: float = 1e-6, least: int = 1) -> np.ndarray:
    """Weights of a logistic scorer on hashed features, by AdaGrad on the whole sample; hashed ones of under `least` rows have none."""
    weights, past = np.zeros(size), np.full(size, 1e-8)
    if not len(target):
        return weights
    often = (np.bincount(buckets, minlength=size)[buckets] >= least) | (buckets >= CONSTANT)
    rows, buckets, values = rows[often], buckets[often], values[often]
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, values * weights[buckets], len(target)), -50, 50)))
        gradient = np.bincount(buckets, values * (p - target)[rows], size) / len(target) + decay * weights
        past += gradient**2
        weights -= RATE * gradient / np.sqrt(past)
    return weights


def _packed(found: tuple[np.ndarray, np.ndarray, np.ndarray], texts: int) -> list[pa.Array]:
    """Features as a row of buckets and a row of values for each text."""
    rows, buckets, values = found
    key, place = np.unique(rows * (4 * BUCKETS) + buckets, return_inverse=True)
    value = np.bincount(place, values)
    row, bucket = np.divmod(key, 4 * BUCKETS)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=texts))])
    return [pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()) for x in (bucket.astype("<u4"), value.astype("<f4"))]


def _unpacked(sample: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buckets = [np.frombuffer(b, "<u4") for b in sample.column(f"{name}_buckets").to_pylist()]
    values = [np.frombuffer(b, "<f4") for b in sample.column(f"{name}_values").to_pylist()]
    flat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
    return np.repeat(np.arange(len(buckets)), [len(b) for b in buckets]).astype(np.int64), flat(buckets, np.int64), flat(values, float)


def fit_guides(docs: DataFrame, labels: DataFrame, label_rows: int = LABEL_ROWS) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights of two guides, one of words and one of beginnings, for each fold, from docs (doc_id, text, fold) and labels (doc_id, toxic).

    Labels of a null id or without a value are ignored; a document with several labels is toxic if one says so. At most
    `label_rows` labelled ids, chosen by their hash, and as many rows are used. Beside, the vote patterns of these rows are
    counted, good ones and toxic ones. None if a fold has rows of one kind only.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("double")).alias("toxic"))
    step = max(1, -(-known.count() // label_rows))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(step)) == 0).limit(label_rows)  # a bounded table

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, column=0, most=1_000_000):
            seen = Seen(as_bytes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *_packed(insult_features(seen), batch.num_rows)], names=["toxic", "fold", "insult_buckets", "insult_values"])

    found = docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic", "fold")
    sample = found.mapInArrow(sparse, "toxic double, fold int, insult_buckets binary, insult_values binary").limit(label_rows).toArrow()
    target, folds = (sample.column("toxic").to_numpy() > 0).astype(float), sample.column("fold").to_numpy()
    rows, buckets, values = _unpacked(sample, "insult")
    guides = np.zeros((2, FOLDS, INSULT_SIZE))
    for fold in range(FOLDS):
        learned = folds != fold
        if len(set(target[learned].tolist())) < 2:
            return None
        place = np.cumsum(learned) - 1
        for guide, part in zip(guides, ((buckets < BUCKETS) | (buckets == CONSTANT), (buckets >= BUCKETS) & (buckets <= CONSTANT))):
            own = part & learned[rows]
            guide[fold] = train(place[rows[own]], buckets[own], values[own], target[learned], INSULT_SIZE, INSULT_DECAY, INSULT_LEAST)
    sent = docs.sparkSession.sparkContext.broadcast(guides)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, column=0, most=1_000_000):
            voted = votes(Seen(as_bytes(batch.column(0))), sent.value, batch.column(2).to_numpy())[1]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(pattern(voted))], names=["toxic", "insult"])

    known = np.zeros((2, 3**4))
    for row in found.mapInArrow(patterns, "toxic double, insult long").groupBy("toxic", "insult").count().collect():
        known[int(row["toxic"] > 0), row["insult"]] += row["count"]
    return guides, known


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, labels: DataFrame | None = None, label_rows: int = LABEL_ROWS) -> DataFrame:
    """doc_id, n_words, weak_quality, weak_insult (from the votes), quality, insult (by the scorers, 0 to 1), keep.

    keep is true where quality is at least a half and insult is below a half. Null, empty and blank texts have quality
    and insult 0 and are not kept. Repeated rows are scored each, null ids are allowed, other columns are ignored; an
    empty table gives no row. The vote patterns of all rows are counted; the scorers are trained on at most about
    `train_rows` rows. labels (doc_id, toxic) fit two labellers of insults on at most `label_rows` rows; without them
    these never vote. Where copies of a text exceed a bound, any of them are taken.
    """
    spark = docs.sparkSession
    source = pick(docs, doc_id=id_col, text=text_col).withColumn("fold", F.pmod(F.xxhash64("text", F.lit(17)), F.lit(FOLDS)).cast("int"))
    guides, known = (labels is not None and fit_guides(source, labels, label_rows)) or (None, None)
    sent_guides = spark.sparkContext.broadcast(guides)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, column=0, most=1_000_000):
            seen = Seen(as_bytes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(pattern(v)) for v in votes(seen, sent_guides.value, batch.column(1).to_numpy())], names=["quality", "insult"])

    counts = source.select("text", "fold").mapInArrow(patterns, "quality long, insult long").groupBy("quality", "insult").count().collect()
    counted: dict[str, dict[int, int]] = {"quality": {}, "insult": {}}
    for row in counts:
        for kind, own in counted.items():
            own[row[kind]] = own.get(row[kind], 0) + row["count"]
    total = sum(counted["quality"].values())
    good = {"quality": estimate(counted["quality"], 8), "insult": estimate(counted["insult"], 4, 0.95, known=known, groups=((0, 1), (2, 3)))}
    sent_good = spark.sparkContext.broadcast(good)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, column=0, most=1_000_000):
            seen = Seen(as_bytes(batch.column(0)))
            voted, insulting = votes(seen, sent_guides.value, batch.column(1).to_numpy())
            arrays = [pa.array(sent_good.value["quality"][pattern(voted)]), pa.array(1 - sent_good.value["insult"][pattern(insulting)])]
            yield pa.RecordBatch.from_arrays([*arrays, *_packed(features(seen), batch.num_rows), *_packed(insult_features(seen), batch.num_rows)], names=[f.split()[0] for f in fields.split(", ")])

    fields = "good double, bad double, quality_buckets binary, quality_values binary, insult_buckets binary, insult_values binary"
    step = max(1, -(-total // train_rows))
    chosen = source.where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(step)) == 0).select("text", "fold")
    # Copies of a text share the hash, so that the sample is cut to its bound as well.
    sample = chosen.mapInArrow(sparse, fields).limit(train_rows).toArrow()
    weights = train(*_unpacked(sample, "quality"), sample.column("good").to_numpy())
    insults = train(*_unpacked(sample, "insult"), sample.column("bad").to_numpy(), INSULT_SIZE, INSULT_DECAY, INSULT_LEAST)
    sent = spark.sparkContext.broadcast((weights, insults))
    schema = T.StructType([source.schema["doc_id"], T.StructField("n_words", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("weak_quality", "weak_insult", "quality", "insult")), T.StructField("keep", T.BooleanType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, most=1_000_000):
            seen = Seen(as_bytes(batch.column(1)))
            voted, insulting = votes(seen, sent_guides.value, batch.column(2).to_numpy())
            rows, buckets, values = features(seen)
            some = seen.n > 0
            quality = np.where(some, 1 / (1 + np.exp(-np.bincount(rows, values * sent.value[0][buckets], len(some)))), 0.0)
            weak = np.where(some, sent_good.value["quality"][pattern(voted)], 0.0)
            weak_insult = np.where(some, 1 - sent_good.value["insult"][pattern(insulting)], 0.0)
            insult = np.where(some, seen.linear(sent.value[1]), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seen.n), *map(pa.array, (weak, weak_insult, quality, insult, (quality >= 0.5) & (insult < 0.5)))], names=[f.name for f in schema])

    return source.mapInArrow(score, schema)
