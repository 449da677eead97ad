import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from cairnlight.llm import sentencepieces as sp
from cairnlight.llm.catalog import TOKENIZER

MODEL = sp.read_model(TOKENIZER)
LATTICE = sp.Lattice(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)


def unigram_proto():
    """The same pieces as a unigram model, with scores by rank."""
    proto = pb.ModelProto()
    with open(TOKENIZER, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    rng = random.Random(8)
    for p in proto.pieces:
        if p.type == sp.NORMAL:
            p.score = -np.log(2 - p.score) - rng.random()
    return proto


UNIGRAM_PROTO = unigram_proto()
UNIGRAM = sp.Lattice(sp.model_tables(UNIGRAM_PROTO))
UNIGRAM_LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=UNIGRAM_PROTO.SerializeToString())


def brute(lattice, model, text, n):
    """The n best of all paths, ordered as the docstrings say."""
    parts = []
    for segment in lattice.segments(pa.array([text]))[0].as_py():
        if not segment:
            continue
        ends, sizes = lattice.merged([segment])
        own, done = dict(zip(ends.tolist(), sizes.tolist())), []

        def go(at, score, ids, starts, segment=segment, own=own, done=done):
            if at == len(segment):
                done.append((-score, starts, ids))
                return
            for end in range(at + 1, min(len(segment), at + model["longest"]) + 1):
                piece = model["pieces"].get(segment[at:end])
                if piece is not None:
                    go(end, score + (0 if own.get(end) == end - at else model["scores"][piece]), (*ids, piece), (at, *starts))
            if segment[at] not in lattice.singles:
                go(at + 1, score + (0 if own.get(at + 1) == 1 else model["unknown"]), (*ids, *(model["bytes"][b] for b in segment[at].encode())), (at, *starts))

        go(0, 0, (), ())
        parts.append(sorted(done))
    paths = [(0, 0, (), 0, ())]
    for k, part in enumerate(parts):
        paths = [(lost + p[0] - part[0][0], changes + (i > 0), (*where, (k, i)) if i else where, score - p[0], (*ids, *p[2])) for lost, changes, where, score, ids in paths for i, p in enumerate(part[: n + 1])]
        paths = sorted(paths)[: 4 * n + 4]
    return [(score / sp.SCALE, ids) for _, _, _, score, ids in paths[:n]]


TIES = st.text(alphabet="bqaeinrst \nüé𐐷", max_size=9)


@settings(max_examples=60, deadline=None)
@given(TIES, st.integers(1, 6))
def test_n_best_against_all_paths(text, n):
    for lattice, model, library in ((LATTICE, MODEL, LIBRARY), (UNIGRAM, sp.model_tables(UNIGRAM_PROTO), UNIGRAM_LIBRARY)):
        got, want = lattice.encode(pa.array([text]), n)[0], brute(lattice, model, text, n)
        assert [(s, tuple(ids.tolist() if len(ids) else ())) for s, ids in got] == want
        for _, ids in got:
            assert lattice.decode(ids, np.array([0, len(ids)]))[0].as_py() == text
            assert library.decode([int(i) for i in ids]) == text


def tie_prone(count):
    rng = random.Random(11)
    return sorted({"".join(rng.choice("bbqqqxz vv") for _ in range(rng.randint(1, 9))) for _ in range(count)} | {"bqqq", "qqqq bqqq", "zzzzzz"})


@pytest.mark.parametrize("n", [2, 4])
def test_ties_do_not_depend_on_the_batch(n):
    texts = tie_prone(400)
    for lattice, model in ((LATTICE, MODEL), (UNIGRAM, sp.model_tables(UNIGRAM_PROTO))):
        together = lattice.encode(pa.array(texts), n)
        for k, text in enumerate(texts):
            got = [(s, tuple(int(i) for i in ids)) for s, ids in together[k]]
            assert len(set(got)) == len(got)
            assert got == [(s, tuple(int(i) for i in ids)) for s, ids in lattice.encode(pa.array([text]), n)[0]]
            if k % 4 == 0:
                assert got == brute(lattice, model, text, n)


def prose():
    import duckdb

    return [r[0] for r in duckdb.execute("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL AND NOT contains(text, '▁') ORDER BY doc_id").fetchall()]


def test_best_is_the_librarys_and_no_path_repeats():
    texts = prose()
    found = LATTICE.encode(pa.array(texts), 4)
    for own, want in zip(found, LIBRARY.encode(texts, num_threads=4)):
        assert own[0][1].tolist() == want and own[0][0] == 0
        assert len({tuple(ids.tolist()) for _, ids in own}) == len(own)
        scores = [s for s, _ in own]
        assert scores == sorted(scores, reverse=True)


def test_unigram_equals_the_library():
    texts = [" ".join(t.split()[:12]) for t in prose()[:300]]
    found = UNIGRAM.encode(pa.array(texts), 4)
    clear = 0
    for text, own in zip(texts, found):
        want = UNIGRAM_LIBRARY.nbest_encode(text, nbest_size=4)
        gaps = [a[0] - b[0] for a, b in zip(own, own[1:])]
        if all(g > 1e-3 for g in gaps):
            clear += 1
            assert [ids.tolist() for _, ids in own[:3]] == want[:3]
            assert own[0][1].tolist() == UNIGRAM_LIBRARY.encode(text)
    assert clear >= 200


def test_vector_and_scalar_searches_agree():
    rng = random.Random(3)
    names = sorted({sp.SPACE + "".join(rng.choice("etaoinshrdlu𐐷") for _ in range(rng.randint(1, 12))) for _ in range(400)})
    for lattice in (LATTICE, UNIGRAM):
        starts, ids, score, loss = lattice.best(names)
        for k, name in enumerate(names):
            two = lattice.nbest(name, 2)
            assert score[k] == two[0][0]
            assert loss[k] == (two[0][0] - two[1][0] if len(two) > 1 else -sp.NONE)
            assert ids[starts[k] : starts[k + 1]].tolist() == list(two[0][1])


def test_query_and_odd_rows(spark, docs_of):
    rows = [(1, "the cat  sat\nhere"), (2, ""), (3, None), (None, "x"), (4, "▁"), (5, "word " * 60_000), (6, "z" * 5000), (1, "the cat  sat\nhere")]
    out = sp.encode(docs_of(rows), TOKENIZER, nbest=3).collect()
    assert sum(r["doc_id"] == 1 for r in out) == 6
    assert [(r["rank"], r["ids"], r["score"], r["round_trip"]) for r in out if r["doc_id"] == 2] == [(1, [], 0.0, True)]
    assert [(r["rank"], r["ids"], r["score"], r["round_trip"]) for r in out if r["doc_id"] == 3] == [(1, None, None, None)]
    assert all(r["round_trip"] for r in out if r["doc_id"] not in (3, 4))
    assert not any(r["round_trip"] for r in out if r["doc_id"] == 4)
    for i in (1, 5, 6):
        s = [r["score"] for r in sorted(out, key=lambda r: r["rank"]) if r["doc_id"] == i]
        assert s == sorted(s, reverse=True)
    assert sp.encode(docs_of([]), TOKENIZER).count() == 0


def test_decoder_column(spark):
    df = spark.createDataFrame([([int(i) for i in LIBRARY.encode("héllo wörld 𐐷")],), ([],), (None,)], "ids array<int>")
    assert [r[0] for r in df.select(sp.decoder(spark, TOKENIZER)("ids")).collect()] == ["héllo wörld 𐐷", "", None]
