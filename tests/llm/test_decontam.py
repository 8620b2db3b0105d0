import hashlib
import random

import numpy as np
import pytest

from marlstone.llm import decontam
from marlstone.llm.common import word_hashes

DOCS = "doc_id long, text string, window string, row string, size int"
ITEMS = "item_id long, text string, size int"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in low).split(" ")


def clean(text):
    return [w for w in words(text) if w]


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = clean(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = clean(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        out.append((-1 if doc is None else doc, len(w), len(hit), len(found), ",".join(sorted(map(str, found)))))
    return sorted(out)


def test_equal_windows_share_the_fingerprint():
    rng = random.Random(2)
    for _ in range(50):
        shared = [str(rng.randrange(40)).encode() for _ in range(10)]
        a, b = ([str(rng.randrange(40)).encode() for _ in range(rng.randrange(9))] for _ in range(2))
        x = decontam.winnow(word_hashes(a + shared + b), 10, 8)[0]
        y = decontam.winnow(word_hashes(b + shared + a), 10, 8)[0]
        assert x[len(a)] == y[len(b)]
    assert not len(decontam.winnow(np.zeros(9, np.uint64), 10, 8)[0])


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_against_brute_force(spark, bits):
    rng = random.Random(7)
    pool = [f"w{i}" for i in range(30)] + ["Été", "x1"]
    line = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, line(rng.choice((10, 11, 25, 40)))) for i in range(12)] + [(20, "short one here"), (21, "short one here"), (22, "tiny"), (23, None), (24, " .,! "), (100, items_text := line(30)), (9, items_text)]
    docs = []
    for i in range(60):
        parts = [line(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(max(1, len(w) - 8))
            parts += [" ".join(w[a : a + rng.choice((9, 10, 12, 30))]).upper().replace(" ", rng.choice((" ", "-", ", "))), line(rng.randrange(6))]
        docs.append((i, " ".join(parts)))
    docs += [(None, "a SHORT-one here, tiny"), (70, None), (71, ""), (72, "tinytiny tiny"), (73, items_text + " " + items_text), (74, " ".join([items_text] * 300))]
    got = decontam.contamination(spark.createDataFrame([(i, t, "", "", 1) for i, t in docs], DOCS), spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS), filter_size=bits)
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"])) for r in got.collect())
    assert found == brute(docs, items)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in got.collect())


def test_repeated_rows_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "one two three", 1)], ITEMS)
    docs = spark.createDataFrame([(1, "one two three", "", "", 1)] * 2 + [(1, "another text", "", "", 1)], DOCS)
    assert sorted((r["doc_id"], r["n_hit"]) for r in decontam.contamination(docs, items).collect()) == [(1, 0), (1, 3)]
    assert decontam.contamination(docs.limit(0), items).collect() == []
    assert {r["n_hit"] for r in decontam.contamination(docs, items.limit(0)).collect()} == {0}
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
