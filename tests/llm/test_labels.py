import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import pytest

from marlstone.llm import langid, licenses, quality

DOCS = "doc_id long, text string, lang string, score string, term string"
SF = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "", "") for i, t, lang in rows], DOCS)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", langid.held_out())
    model = langid.train(docs.where("NOT held_out"))
    told = langid.predict(docs.where("held_out").select("doc_id", "text", "lang"), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in told]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in told)


def test_mixtures(spark):
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    text = lambda letters, n: " ".join(word(letters) for _ in range(n))
    rows = [(i, text("abcde", 50), "x") for i in range(20)] + [(i, text("lmnop", 50), "y") for i in range(20)] + [(9, "ignored", None), (9, None, "x")]
    model = langid.train(frame(spark, rows))
    assert model.names == ["x", "y"]
    asked = [(1, text("abcde", 40), None), (2, text("abcde", 30) + " " + text("lmnop", 10), None), (None, None, None), (4, "", None), (5, "12 ... ! ½ ² ① Ⅷ", None), (6, "é", None), (6, "é", None), (7, text("lmnop", 30_000), "x")]
    got = langid.predict(frame(spark, asked), model).collect()
    assert [r["lang_pred"] for r in got if r["doc_id"] in (1, 7)] == ["x", "y"] and len(got) == len(asked)
    mixed = next(r for r in got if r["doc_id"] == 2)
    assert {s["lang"] for s in mixed["languages"]} == {"x", "y"} and mixed["score_"] == pytest.approx(0.75, abs=0.03)
    assert next(r for r in got if r["doc_id"] == 1)["score_"] == 1
    assert [(r["lang_pred"], r["score_"]) for r in got if r["doc_id"] in (None, 4, 5)] == [("und", 0.0)] * 3
    none = langid.train(frame(spark, []))
    assert {r["lang_pred"] for r in langid.predict(frame(spark, asked), none).collect()} == {"und"}
    assert langid.predict(frame(spark, []), model).collect() == []


def brute_mixture(model, words, rounds):
    """Expectation-maximisation word by word, for the set of languages that has the best penalised likelihood."""
    logs = [model.words([w])[0].astype(float) for w in words]

    def fit(shares, n):
        for _ in range(n):
            total = dict.fromkeys(shares, 0.0)
            for x in logs:
                part = {k: s * math.exp(x[k] - max(x)) for k, s in shares.items()}
                for k, v in part.items():
                    total[k] += v / sum(part.values())
            shares = {k: v / len(logs) for k, v in total.items()}
        return shares, sum(max(x) + math.log(sum(s * math.exp(x[k] - max(x)) for k, s in shares.items())) for x in logs)

    shares, _ = fit({k: 1 / len(model.names) for k in range(len(model.names))}, rounds)
    order = sorted(shares, key=lambda k: -shares[k])
    best = None
    for n in range(1, len(order) + 1):
        start = {k: max(shares[k], 1e-3) for k in order[:n]}
        found, value = fit({k: v / sum(start.values()) for k, v in start.items()}, 0 if n == 1 else rounds // 2)
        value -= 0.5 * n * math.log(len(words) + 1)
        if best is None or value > best[0]:
            best = (value, found)
    return {model.names[k]: v for k, v in best[1].items()}


def test_mixtures_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.where("doc_id % 2 = 0"))
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id % 2 = 1").orderBy("doc_id").limit(60).collect()}
    mixed = {10_000 + i: " ".join(a.split()[:40] + b.split()[:25]) for i, (a, b) in enumerate(itertools.pairwise(texts.values()))}
    asked = {i: t for i, t in (texts | mixed).items() if any(c.isalpha() for c in t)}
    for r in langid.predict(spark.createDataFrame(list(asked.items()), "doc_id long, text string"), model).collect():
        words = "".join(c if c.isalpha() else " " for c in r["text"].lower()).split()
        want = brute_mixture(model, [w.encode() for w in words[:20_000]], langid.ROUNDS)
        if len(words) <= 20_000:
            assert {s["lang"]: s["share"] for s in r["languages"] if s["share"] > 1e-4} == {k: pytest.approx(v, abs=2e-3) for k, v in want.items() if v > 1e-4}


def test_long_texts_and_user_columns(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    rows = [(1, docs.where("lang = 'de'").first()["text"] * 3, "Ab", [1])]
    df = spark.createDataFrame(rows, "doc_id long, score string, LANG_pred string, languages array<int>")
    whole = langid.predict(df, model, text_col="score").first()
    assert whole["LANG_pred"] == "Ab" and whole["languages"] == [1] and whole["lang_pred_"] == "de" and whole["score"] == rows[0][1]
    monkeypatch.setattr(langid, "MANY", 10)
    assert langid.predict(df, model, text_col="score").first()["score_"] == pytest.approx(whole["score_"], abs=1e-6)


def test_more_than_three_languages(spark):
    rng = random.Random(6)
    letters = {"a": "abcd", "b": "efgh", "c": "ijkl", "d": "mnop", "e": "qrst"}
    text = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(3, 7))) for _ in range(n))
    model = langid.train(frame(spark, [(i, text(lang, 50), lang) for lang in letters for i in range(10)]))
    asked = [(k, " ".join(text(lang, 60 - 5 * i) for i, lang in enumerate(list(letters)[:k])), None) for k in range(1, 6)]
    for r in langid.predict(frame(spark, asked), model).collect():
        want = {lang: (60 - 5 * i) / sum(60 - 5 * j for j in range(r["doc_id"])) for i, lang in enumerate(list(letters)[: r["doc_id"]])}
        assert {s["lang"]: s["share"] for s in r["languages"]} == {k: pytest.approx(v, abs=0.02) for k, v in want.items()}


def test_em_finds_accuracies():
    rng = np.random.default_rng(3)
    n, right = 20_000, np.array([0.95, 0.9, 0.8, 0.7, 0.55])
    truth = rng.random(n) < 0.7
    votes = np.where(rng.random((n, 5)) < right, truth[:, None], ~truth[:, None])
    coded = np.where(rng.random((n, 5)) < 0.2, 0, np.where(votes, 1, 2))
    codes, counts = np.unique(quality.pattern(coded), return_counts=True)
    good = quality.estimate(dict(zip(codes.tolist(), counts.tolist())), 5)
    assert np.mean((good[quality.pattern(coded)] > 0.5) == truth) > 0.93
    assert (np.abs(quality.estimate({}, 5)) <= 1).all()


def test_quality_of_labelled_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = {r["doc_id"]: r for r in quality.classify(docs).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SF}/labels.parquet'").fetchall()
    good = [told[i]["quality"] >= 0.5 for i, q, _ in labels if q]
    bad = [told[i]["quality"] >= 0.5 for i, q, _ in labels if not q]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.1
    assert not any(told[i]["insult"] >= 0.5 for i, _, t in labels if not t)


def test_quality_edges(spark):
    rows = [(1, None, ""), (2, "", ""), (3, " \n", ""), (None, "one", ""), (5, "The idiot and the moron of stupid scum. " * 5, ""), (6, "x " * 50_000, ""), (6, "x", "")]
    got = quality.classify(frame(spark, rows)).collect()
    assert len(got) == 7 and all(r["quality"] == 0 and not r["keep"] for r in got if r["doc_id"] in (1, 2, 3))
    assert next(r for r in got if r["doc_id"] == 5)["insult"] > 0.5
    assert quality.classify(frame(spark, [])).collect() == []


def test_insults_of_labels_not_seen(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    labelled = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    told = {r["doc_id"]: r["insult"] >= 0.5 for r in quality.classify(labelled, labels=labels.where(~langid.held_out())).collect()}
    unseen = duckdb.sql(f"SELECT doc_id, lang, toxic FROM '{base}/labels.parquet' JOIN '{base}/documents.parquet' USING (doc_id)").fetchall()
    unseen = [r for r in unseen if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([told[i] for i, lang, toxic in unseen if toxic and lang == "en"]) > 0.85
    assert np.mean([told[i] for i, lang, toxic in unseen if toxic and lang != "en"]) > 0.6
    assert np.mean([told[i] for i, _, toxic in unseen if not toxic]) < 0.01


def test_labels_edges(spark):
    rows = [(1, None, ""), (None, "one two", ""), (3, "x " * 40_000, ""), (3, "y", ""), (4, "", "")] + [(10 + i, "Grumbel you are " * 9, "") for i in range(30)] + [(50 + i, "a fine day for all " * 9, "") for i in range(30)]
    known = [(10 + i, 1, "t") for i in range(30)] + [(50 + i, 0, "t") for i in range(30)] + [(1, 1, "t"), (None, 1, "t"), (3, None, "t"), (3, 0, "t"), (3, 0, "t"), (999, 1, "t")]
    frame_of = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int, text string")
    for labels in (frame_of(known), frame_of([]), frame_of(known[:30]), None):
        got = quality.classify(frame(spark, rows), labels=labels).collect()
        assert len(got) == len(rows) and all(r["insult"] == 0 and not r["keep"] for r in got if r["doc_id"] in (1, 4))
    assert quality.classify(frame(spark, []), labels=frame_of(known)).collect() == []


def test_kinds_of_bad():
    """Two pairs of labellers that see different things, each pair voting alike, so that one kind of bad cannot explain both."""
    rng = np.random.default_rng(5)
    n = 20_000
    kind = rng.choice(3, n, p=[0.92, 0.04, 0.04])
    see = lambda k: np.where(kind == k, np.where(rng.random(n) < 0.9, 2, 1), np.where(rng.random(n) < 0.999, 1, 2))
    coded = np.stack([see(1), see(1), see(2), see(2)], axis=1)
    codes, counts = np.unique(quality.pattern(coded), return_counts=True)
    counted = dict(zip(codes.tolist(), counts.tolist()))
    good = quality.estimate(counted, 4, 0.95, groups=((0, 1), (2, 3)))
    truth = np.stack([np.bincount(quality.pattern(coded), kind == k, 81) for k in (0, 1, 2)])
    brute = truth[0] / np.maximum(truth.sum(axis=0), 1)
    often = [c for c, k in counted.items() if k >= 100]
    assert np.abs(good[often] - brute[often]).max() < 0.1
    known = np.stack([truth[0] / 10, (truth[1] + truth[2]) / 10])
    assert np.abs(quality.estimate(counted, 4, 0.95, known=known, groups=((0, 1), (2, 3)))[often] - brute[often]).max() < 0.1


def test_licences(spark):
    apache, mit, gpl = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("a/LICENSE", "Foreword\n" + mit), ("a/b/x.c", "code"), ("a/b/y.c", "// " + gpl + "\ncode of many words here"), ("a/b/COPYING.txt", apache), ("a/b/c/d/z.c", None), ("q.c", "nothing licensed to speak of at all, in no way"),
        ("d/e.c", "code"), (None, gpl), ("a/b/y.c", "more"), ("long.c", "w " * 100_000 + "\n" + mit), ("d/f.c", ""),
    ]
    got = {r["path"]: r[1:] for r in licenses.scan(spark.createDataFrame([(p, t, "", 1) for p, t in rows], "path string, text string, license string, n int")).collect()}
    brief = {p: (r[0], r[2], r[3]) for p, r in got.items()}
    assert brief == {
        "a/LICENSE": ("MIT", "header", None), "a/b/x.c": ("Apache-2.0", "inherited", "a/b"), "a/b/y.c": ("GPL-3.0", "header", None), "a/b/COPYING.txt": ("Apache-2.0", "file", None),
        "a/b/c/d/z.c": ("Apache-2.0", "inherited", "a/b"), "q.c": (None, None, None), "d/e.c": (None, None, None), None: ("GPL-3.0", "file", None), "long.c": ("MIT", "header", None), "d/f.c": (None, None, None),
    }
    assert got["a/b/COPYING.txt"][1] == 1 and 0.6 <= got["a/b/y.c"][1] <= 1
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).collect() == []
