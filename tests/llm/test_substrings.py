import random

import numpy as np
import pytest

from marlstone.llm import substrings

DOCS = "doc_id long, text string, id string, row string, starts string"


def words(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def brute(rows, span):
    """Rows that share id and text are one document; ids are unique otherwise."""
    first, out = {}, []
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        w = words(t)
        gone = set()
        for a in range(len(w) - span + 1):
            if first.setdefault(tuple(w[a : a + span]), (i, a)) != (i, a):
                gone |= set(range(a, a + span))
        out.append((i, t, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    told = {(i, t): r for i, t, *r in out}
    return sorted([(repr(i), *told[i, t]) for i, t in rows])


@pytest.mark.parametrize("span,group,held", [(20, 400_000, 250_000), (3, 40, 25), (5, 10, 1)])
def test_against_brute_force(spark, monkeypatch, span, group, held):
    monkeypatch.setattr(substrings, "HELD", held)
    rng = random.Random(span)
    pool = [f"w{i}" for i in range(4 if span < 10 else 60)] + ["é", "W0"]
    line = lambda n: [rng.choice(pool) for _ in range(n)]
    shared = [line(rng.randint(span - 1, 3 * span)) for _ in range(6)]
    rows = []
    for i in rng.sample(range(1000), 60):
        parts = line(rng.randrange(2 * span))
        for _ in range(rng.randrange(3)):
            parts += rng.choice(shared) + line(rng.randrange(span))
        rows.append((i, rng.choice(" \n\t").join(parts)))
    rows += [(2000 + i, rows[i][1]) for i in range(5)] + [rows[3], (3000, None), (3001, ""), (3002, " "), (3003, "x " * 70), (None, rows[0][1]), (3004, "a\xa0b " * 30)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "", "", "") for i, t in rows], DOCS).repartition(3)
    got = substrings.remove_repeats(df, span=span, group=group).collect()
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute(rows, span)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_rows_that_share_an_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text + " more"), (2, text)]
    got = substrings.remove_repeats(spark.createDataFrame([(i, t, "", "", "") for i, t in rows], DOCS)).collect()
    assert len(got) == 3 and {r["n_removed"] for r in got if r["doc_id"] == 2} == {30}
    assert sorted(r["n_removed"] for r in got if r["doc_id"] == 1) == [0, 30]


def test_full_prefixes_get_longer(spark, monkeypatch):
    """Suffixes that share four words and more are split by longer prefixes, until a group fits."""
    monkeypatch.setattr(substrings, "HELD", 100)
    rows = [(i, " ".join(["the"] * 5 + [f"w{i // 2 + j}" for j in range(30)] + [f"u{i}"])) for i in range(80)]
    docs = spark.createDataFrame([(i, i, t) for i, t in rows], "id long, row long, text string")
    runs = substrings.candidate_runs(docs, substrings.repeated_anchors(docs)).cache()
    full = substrings.full_prefixes(runs, group=30)
    assert len(full) == 5 and all(len(x) for x in full)  # "the", ..., "the" five times; six words are rare enough
    sizes = {}
    for batch in runs.toArrow().to_batches():
        h, at, _, _ = substrings._suffixes(batch, 20)
        for g in substrings._groups(h, at, full, 1 << 40).tolist():
            sizes[g] = sizes.get(g, 0) + 1
    assert max(sizes.values()) <= 30 * 2
    got = substrings.remove_repeats(docs.select("id", "text"), "id", group=30).collect()
    assert sorted((repr(r["id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute(rows, 20)


def test_nodes_of_a_tree():
    paths = substrings._paths(np.array([7, 8, 9, 7, 8, 9, 7, 8], np.uint64) << np.uint64(48), np.arange(6), 3)
    order = np.argsort(paths, kind="stable")
    assert substrings.common_words(paths[order], 3).tolist() == [0, 3, 0, 3, 0, 3]
    repeat, first = substrings.deep_nodes(paths, np.array([5, 5, 5, 2, 2, 2]), np.arange(6), 3)
    assert sorted(repeat.tolist()) == [0, 1, 2] and sorted(first.tolist()) == [3, 4, 5]


def test_user_columns_stay(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, "a", 5), (2, text, "b", 6)], "doc_id long, text string, n_words string, Kept int")
    got = {r["doc_id"]: r for r in substrings.remove_repeats(df).collect()}
    assert [got[i]["n_words"] for i in (1, 2)] == ["a", "b"] and [got[i]["Kept"] for i in (1, 2)] == [5, 6]
    assert [(got[i]["n_words_"], got[i]["kept_"]) for i in (1, 2)] == [(30, text), (30, "")]
    again = substrings.remove_repeats(df, text_col="n_words").collect()
    assert {r["kept_"] for r in again} == {"a", "b"}


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []
