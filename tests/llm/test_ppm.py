import math
import random
import zlib

import numpy as np
import pytest

from marlstone.llm import ppm

DOCS = "doc_id long, text string, word string, n string"


def brute_stream(words):
    return b"     " + b"".join(w + b" " for w in words) + b"\n"


def brute_counts(texts):
    """Contexts of up to five bytes, across words, over texts that are lists of words."""
    tree = {}
    for words in texts:
        line = brute_stream(words)
        for i in range(5, len(line)):
            for k in range(ppm.ORDER + 1):
                node = tree.setdefault(line[i - k : i], {})
                node[line[i]] = node.get(line[i], 0) + 1
    return tree


def brute_symbol(tree, context, symbol):
    p, excluded = 1.0, set()
    while True:
        node = tree.get(context)
        if node:
            left = {s: n for s, n in node.items() if s not in excluded}
            if left:
                size = sum(left.values())
                if symbol in left:
                    return p * (left[symbol] - 0.5) / size
                p *= 0.5 * len(left) / size
            excluded |= set(node)
        if not context:
            return p / (256 - len(excluded))
        context = context[1:]


def brute_text(tree, words):
    line = brute_stream(words)
    return sum(math.log10(brute_symbol(tree, line[i - ppm.ORDER : i], line[i])) for i in range(5, len(line)))


def split(text):
    return (text or "").encode().lower().split()


def test_streams():
    keys, n = ppm.streams([b"Ab  c", None, b"", b"x"])
    want = [line[i - 5 : i + 1] for line in (b"     ab c \n", b"     \n", b"     \n", b"     x \n") for i in range(5, len(line))]
    assert n.tolist() == [6, 1, 1, 3] and [int(k).to_bytes(6, "big") for k in keys] == want


def test_trie_against_brute_force():
    rng = random.Random(3)
    texts = [[bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 9))] for _ in range(30)] + [["é".encode()]]
    tree = brute_counts(texts)
    keys, _ = ppm.streams([b" ".join(t) for t in texts])
    own = ppm.merged(keys, np.ones(len(keys), np.int64))
    trie = ppm.Trie(*ppm.merged(*(np.concatenate(x) for x in zip(*(ppm.shortened(*own, k) for k in range(6))))))
    for context in (b"     ", b"ab ca", b"zzzzz", b"  bbz", b"abcab", b"ab  c"):
        key = np.full(256, 5 << 48 | int.from_bytes(context, "big"), np.uint64)
        found = 10.0 ** trie.symbols(key, np.arange(256))
        assert found.sum() == pytest.approx(1)
        assert found.tolist() == [pytest.approx(brute_symbol(tree, context, s)) for s in range(256)]


def test_known_keys():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 48, 5000, dtype=np.uint64))
    known = ppm.Known(keys)
    assert (known.find(keys) == np.arange(len(keys))).all() and (known.find(keys + np.uint64(1 << 50)) == len(keys)).all()
    assert ppm.Known(keys[:0]).find(keys[:3]).tolist() == [0, 0, 0]


@pytest.mark.parametrize("frequent", [0, 5, 1 << 18])
def test_documents(spark, frequent):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(50)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(40)]
    rows += [(7, rows[7][1]), (None, "A b\tUnseen"), (50, None), (51, ""), (52, "QQ qq " * 3), (53, "x" * 70_000), (54, "A\x0bB"), (54, "another text")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    from marlstone.llm.langid import held_out

    learned = ~held_out(parts=5, part=1)
    got = ppm.score(df, learned if frequent else df.where(learned), frequent=frequent).collect()
    words, ends = {}, 0
    for i, t in rows:
        if not held(i):
            ends += 1
            for w in split(t):
                words[w] = words.get(w, 0) + 1
    n, v = sum(words.values()) + ends, len(words) + 1
    tree = brute_counts([split(t) for i, t in rows if not held(i)])
    want = []
    for i, t in rows:
        tokens = split(t)
        counts = [words.get(w, 0) for w in tokens] + [ends]
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in counts)
        want.append((-1 if i is None else i, len(counts), sum(c > 0 for c in counts), n, round(base, 6), round(brute_text(tree, tokens), 6)))
    assert sorted((-1 if r[0] is None else r[0], r[1], r[2], r[3], round(r[4], 6), round(r[5], 6)) for r in got) == sorted(want)


def test_mixture_of_classes(spark):
    rows = [(1, "ab ab ba", "x"), (2, "ab aab", "x"), (3, "zz zy", "y"), (4, "q", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = [(9, "ab zz"), (10, "ab ab"), (11, "")]
    got = {r["doc_id"]: r["score"] for r in ppm.score(spark.createDataFrame(texts, "doc_id long, text string"), df, class_col="lang").collect()}
    trees = [(brute_counts([split(t) for _, t, k in rows if k == c]), share / 4) for c, share in (("x", 2), ("y", 1), (None, 1))]
    for i, t in texts:
        assert got[i] == pytest.approx(math.log10(sum(share * 10 ** brute_text(tree, t.encode().split()) for tree, share in trees)))


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert ppm.score(none, none).collect() == []
    got = ppm.score(spark.createDataFrame([(1, "ab", "", "")], DOCS), none).first()
    assert got["n_known"] == 0 and got["base_score"] == 0 and got["score"] == pytest.approx(-4 * math.log10(256))


def test_no_context_is_left_out(spark):
    """Whatever a task holds, rare contexts are kept: all scores equal those of the whole tries."""
    rng = random.Random(8)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(30))) for i in range(20)] + [(20, "once only abcdefgh"), (21, "onceonly " * 9 + "y" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = df.where("doc_id % 3 <> 1")
    tree = brute_counts([split(t) for i, t in rows if i % 3 != 1])
    want = {i: pytest.approx(brute_text(tree, split(t))) for i, t in rows}
    for entries, group in ((0, 1 << 20), (25, 40), (1 << 20, 3)):
        assert {r["doc_id"]: r["score"] for r in ppm.score(df, train, entries=entries, frequent=10, group=group).collect()} == want


def test_order_of_words_counts(spark):
    rows = [(i, "the quick brown fox jumps") for i in range(9)]
    asked = [(100, "the quick brown fox jumps"), (101, "jumps fox the brown quick")]
    got = {r["doc_id"]: r["score"] for r in ppm.score(spark.createDataFrame(asked, "doc_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] > got[101] + 3
