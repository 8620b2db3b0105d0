import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import media

DOCS = "doc_id long, text string, media string, n_bytes string"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40_000), st.randoms())
def test_round_trip(n, rng):
    data = rng.randbytes(n)
    stream = media.write_stream(data)
    found = media.read_stream(stream)
    assert len(stream) % 188 == 0 and set(stream[::188]) == {0x47}
    assert found["payload"] == data and not found["counter_errors"] and not found["broken"]
    assert found["programs"] == {1: media.PMT_PID} and found["streams"] == {media.STREAM_PID: 6}
    assert found["pes"] == -(-n // media.UNIT) and len(found["entries"]) == -(-n // (media.UNIT * media.GROUP))
    assert found["stamps"] == [i * media.UNIT * 90_000 // media.RATE for i in range(found["pes"])]
    for stamp, packet in found["entries"]:
        assert stream[188 * packet + 5] & 0x40


def test_every_last_packet_size():
    for n in range(1, 400):
        data = bytes(i & 255 for i in range(n))
        assert media.read_stream(media.write_stream(data))["payload"] == data


def test_lost_and_damaged_packets_show():
    data = random.Random(1).randbytes(20_000)
    stream = media.write_stream(data)
    assert media.read_stream(stream[: 188 * 5] + stream[188 * 6 :])["counter_errors"] == 1
    assert media.read_stream(stream[: 188 * 5] + b"\x00" + stream[188 * 5 + 1 :])["broken"] >= 1
    assert media.read_stream(stream[:10] + bytes([stream[10] ^ 1]) + stream[11:])["broken"] >= 1
    assert media.section_crc(b"123456789") == 0x0376E6E7


def test_documents(spark, tmp_path):
    rows = [(1, "abc"), (2, None), (None, ""), (3, "é" * 50_000), (3, "abc"), (3, "abc")]
    got = media.transport_streams(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS), str(tmp_path / "m")).collect()
    assert len(got) == 6
    by_hash = {}
    for r in got:
        by_hash.setdefault(r["payload_sha256"], set()).add(r[1:])
    for _, t in rows:
        raw = (t or "").encode()
        pay = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        (r,) = by_hash[hashlib.sha256(pay).hexdigest()]
        assert r[:2] == (len(raw), len(pay)) and r[3] == zlib.crc32(pay[-64:])
        assert r[5] == hashlib.sha256(media.write_stream(pay)).hexdigest() and "counter_errors=0;broken=0" in r[6]


def test_empty_table(spark, tmp_path):
    assert media.transport_streams(spark.createDataFrame([], DOCS), str(tmp_path / "m")).collect() == []
