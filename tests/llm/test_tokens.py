import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marlstone.llm import packing, tokenfile
from marlstone.llm.tokens import WordTokenizer

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
DOCS = "doc_id long, text string, length string, part string"
ODD = [None, "", " ", "a\x01b <|endoftext|> x<|startoftext|>y É É T̈ \x01", "\x85a b\xa0c it's don'tt 12 34 ½ ", "<|STARTOFTEXT|> İ ǅ ﬁ", "It's WE'LL x__y!! ÀÉßü×÷ µª²", "你好 мир x", "A" * 3000, "word " * 5000]


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def texts(n=40, seed=1):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefgh'.é") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    return [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 120))) for _ in range(n)]


@pytest.mark.parametrize("known", [5, 200_000])
def test_pieces_equal_whole_texts(whole, known):
    coder = WordTokenizer(PATH, known=known)
    rows = ODD + texts()
    for a in range(0, len(rows), 7):
        part = rows[a : a + 7]
        ids, edges = coder.encode(pa.array(part, pa.string()))
        assert [ids[x:y].tolist() for x, y in zip(edges, edges[1:])] == [whole(t) for t in part]


@pytest.mark.parametrize("unit", ["byte", "bit"])
def test_planes_round_trip(unit):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 1000, 65_536):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
        assert (tokenfile.unshuffle_block(tokenfile.shuffle_block(ids, unit), n) == ids).all()


@pytest.mark.parametrize("unit,block,chunk", [("byte", 1 << 16, 1 << 18), ("bit", 100, 300)])
def test_token_table(spark, tmp_path, whole, unit, block, chunk):
    rows = list(zip([5, None, 3, 3, 3, 40, 41, 42, 43], ODD)) + list(enumerate(texts(), 100)) + [(5, ODD[0])]
    random.Random(3).shuffle(rows)
    got = tokenfile.token_planes(spark.createDataFrame([(i, t, "", "") for i, t in rows], DOCS).repartition(5), str(tmp_path / "t"), PATH, unit=unit, block_ids=block, chunk_ids=chunk).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r["start"])
    key = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert key == sorted(key)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((-1 if i is None else i, len(whole(t)), crc(whole(t))) for i, t in rows)


@pytest.mark.parametrize("size", [64, 4096])
def test_packing(spark, whole, size):
    rows = list(zip([5, None, 3, 3, 3, 40, 41, 42, 43], ODD)) + list(enumerate(texts(200), 100))
    got = packing.pack(spark.createDataFrame([(i, t, "", "") for i, t in rows], DOCS).repartition(3), PATH, size=size).collect()
    want = []
    for i, t in rows:
        ids = whole(t)
        want += [(-1 if i is None else i, k, a, len(ids[a : a + size]), zlib.crc32(np.array(ids[a : a + size], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), size))]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    fill = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= size and len(fill) <= -(-sum(fill.values()) // size) * 1.15 + 1


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(2)
    for size, lengths in ((4096, rng.integers(1, 4097, 5000)), (4096, rng.lognormal(6, 1, 20_000).clip(1, 4096).astype(int)), (100, np.full(77, 100)), (100, np.full(50, 60)), (4096, np.array([], int))):
        histogram = np.bincount(lengths, minlength=size + 1)
        runs = packing.plan(histogram, size)
        fill = np.zeros(int((runs["sequence"] + runs["count"]).max(initial=0)), int)
        ranks = {}
        for length, rank, count, sequence, offset in zip(*runs.values()):
            assert (fill[sequence : sequence + count] == offset).all()
            fill[sequence : sequence + count] += length
            ranks.setdefault(length, []).append((rank, count))
        assert fill.max(initial=0) <= size and (fill > 0).all()
        for length, parts in ranks.items():
            at = 0
            for rank, count in sorted(parts):
                assert rank == at
                at += count
            assert at == histogram[length]
    assert len(fill) == 0
    many = packing.plan(np.bincount(rng.lognormal(6, 1, 20_000).clip(1, 4096).astype(int), minlength=4097))
    assert (many["sequence"] + many["count"]).max() <= 1.01 * -(-int((many["length"] * many["count"]).sum()) // 4096)


def test_nnls_against_enumeration():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a, b = rng.random((6, 4)), rng.random(6)
        best = min(
            (np.linalg.norm(a[:, s] @ x - b) for m in range(16) for s in [[j for j in range(4) if m >> j & 1]] for x in [np.linalg.lstsq(a[:, s], b, rcond=None)[0] if s else np.zeros(0)] if (x >= 0).all()),
        )
        x = packing.nnls(a, b)
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) == pytest.approx(best)


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], DOCS)
    assert packing.pack(none, PATH).collect() == []
    assert tokenfile.token_planes(none, str(tmp_path / "t"), PATH).collect() == []
