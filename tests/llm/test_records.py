import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnlight.llm import records
from cairnlight.llm.catalog import RANKS

TOKENIZER = records.Tokenizer(records.read_ranks(RANKS))


def crc_bytes(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def mask(c):
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def test_known_checksum():
    data = np.frombuffer(b"123456789", np.uint8)
    assert records.crc32c(data, np.array([0, 9]))[0] == 0xE3069283


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=700), max_size=6))
def test_checksums_and_frames(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    assert records.crc32c(data, offsets).tolist() == [crc_bytes(p) for p in parts]
    out, starts, _ = records.frame(data, offsets)
    want = b"".join(struct.pack("<Q", len(p)) + struct.pack("<I", mask(crc_bytes(struct.pack("<Q", len(p))))) + p + struct.pack("<I", mask(crc_bytes(p))) for p in parts)
    assert out == want
    assert [out[s : s + 8] for s in starts] == [struct.pack("<Q", len(p)) for p in parts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab1 \n\té,'", max_size=12), min_size=1, max_size=5))
def test_batched_tokens_equal_the_library(texts):
    ids, offsets = TOKENIZER.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [TOKENIZER.coder.encode_ordinary(t) for t in texts]


def test_shuffled_round_trip_and_odd_rows(docs_of, tmp_path):
    rows = [(i, f"some words {i}\nand more" * (i % 5)) for i in range(60)] + [(None, "no id"), (100, None), (101, ""), (102, "long " * 80_000), (3, "again")]
    path = f"file://{tmp_path}/out"
    index = records.write_records(docs_of(rows).repartition(3), path, RANKS)
    assert index.count() == len(rows) - 1
    got = records.read_records(index.orderBy(F.rand(3)), path).collect()
    want = sorted((repr(i), TOKENIZER.coder.encode_ordinary(t)) for i, t in rows if t is not None)
    assert sorted((repr(r["doc_id"]), r["ids"]) for r in got) == want
    assert all(r["n_tokens"] * 2 == r["length"] for r in got)
    assert not [f for f in (tmp_path / "out").iterdir() if f.name.startswith(".part")]


def test_damage_is_found(docs_of, tmp_path):
    path = f"file://{tmp_path}/out"
    index = records.write_records(docs_of([(1, "some words")]), path, RANKS)
    (name,) = [f for f in (tmp_path / "out").iterdir() if f.suffix == ".rec" and f.stat().st_size]
    raw = bytearray(name.read_bytes())
    raw[14] ^= 1
    name.write_bytes(raw)
    with pytest.raises(Exception, match="damaged"):
        records.read_records(index, path).collect()


def test_empty_table(docs_of, tmp_path):
    assert records.write_records(docs_of([]), f"file://{tmp_path}/out", RANKS).count() == 0


def test_lost_attempts_leave_nothing(spark, docs_of, tmp_path):
    out = f"file://{tmp_path}/out"
    index = records.write_records(docs_of([(i, f"text {i}") for i in range(20)]), out, RANKS)
    (tmp_path / "out/part-000000-999999.rec").write_bytes(b"other bytes of a lost attempt")
    (tmp_path / "out/.part-000001-999998.rec").write_bytes(b"half")
    assert records.drop_orphans(index, out) == [".part-000001-999998.rec", "part-000000-999999.rec"]
    assert records.drop_orphans(index, out) == []
    assert records.read_records(index, out).count() == 20
    named = {r[0] for r in index.select("file").distinct().collect()}
    assert named == {p.name for p in (tmp_path / "out").iterdir() if p.name.endswith(".rec")}
