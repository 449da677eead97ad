import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from cairnlight.llm import simhash


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def corpus(seed=5):
    rng = random.Random(seed)
    rows, groups = [], []
    for g in range(40):
        base = words(rng, rng.randint(60, 200))
        ids = []
        for k in range(rng.choice((1, 1, 2, 3, 6))):
            w = list(base)
            for _ in range(0 if k < 2 else len(w) // 40):
                w[rng.randrange(len(w))] = words(rng, 1)[0]
            ids.append(len(rows) * 3 + 7)
            rows.append((ids[-1], " ".join(w)))
        groups.append(ids)
    return rows, groups


def test_groups_and_odd_rows(docs_of):
    rows, groups = corpus()
    odd = [(None, rows[0][1]), (9001, None), (9002, ""), (9003, " \n "), (9004, ""), (rows[3][0], rows[3][1])]
    got = {(r["doc_id"], r["duplicate_of"]) for r in simhash.near_duplicates(docs_of(rows + odd)).collect()}
    assert got == {(i, min(ids)) for ids in groups for i in ids if i != min(ids)}


def test_candidates_against_all_pairs(spark, docs_of):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 18, (60, 7))
    fps = [base] + [base ^ np.array([[sum(1 << int(b) for b in rng.choice(18, rng.integers(0, 4), replace=False)) for _ in range(7)] for _ in range(60)]) for _ in range(3)]
    fp = np.unique(np.concatenate(fps), axis=0)
    df = spark.createDataFrame([(i, [int(x) for x in f]) for i, f in enumerate(fp)], "id long, fp array<long>")
    got = {(r["a"], r["b"]) for r in simhash.candidate_pairs(df, 7, 18, 13).collect()}
    dist = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2)
    assert got == {(a, b) for a, b in zip(*np.nonzero(dist <= 13)) if a < b}


def far_pairs(n=150):
    """Fingerprints and sketches in pairs of which every segment is 2 to 4 bits apart."""
    rng = np.random.default_rng(8)
    fp = np.column_stack([rng.integers(0, 1 << 18, (n, 7)), rng.integers(0, 1 << simhash.SKETCH_BITS, n)])
    flip = lambda width, k: sum(1 << int(b) for b in rng.choice(width, k, replace=False))
    other = fp ^ np.array([[flip(18, k) for k in rng.choice((2, 3, 3, 4), 7)] + [flip(simhash.SKETCH_BITS, rng.integers(8, 18))] for _ in range(n)])
    other[: n // 3] = fp[: n // 3] ^ np.array([[flip(18, k) for k in rng.permutation((3, 3, 3, 3, 3, 3, 4))] + [flip(simhash.SKETCH_BITS, 14)] for _ in range(n // 3)])
    return np.concatenate([fp, other])


def all_pairs(fp, most, sketch):
    apart = np.bitwise_count(fp[:, None] ^ fp[None])
    near = (apart[:, :, :-1].sum(axis=2) <= most) & (apart[:, :, -1] <= sketch)
    return {(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b}, apart[:, :, :-1].min(axis=2)


def test_pairs_without_a_segment_in_common(spark, monkeypatch):
    """At the default distances, in blocks, for ids of any type."""
    fp = far_pairs()
    want, least = all_pairs(fp, simhash.MAX_DISTANCE, simhash.SKETCH_DISTANCE)
    assert len(want) > 60 and all(least[p] > 1 for p in want)
    df = spark.createDataFrame([(i, [int(x) for x in f]) for i, f in enumerate(fp)], "id long, fp array<long>")
    named = df.selectExpr("printf('%05d', id) AS id", "fp")
    for rows in (100, 1 << 14):
        monkeypatch.setattr(simhash, "LEAST_ROWS", rows)
        assert sorted((r["a"], r["b"]) for r in simhash.candidate_pairs(df, 7, 18, simhash.MAX_DISTANCE).collect()) == sorted(want)
    assert {(int(r["a"]), int(r["b"])) for r in simhash.candidate_pairs(named, 7, 18, simhash.MAX_DISTANCE).collect()} == want


def test_search_by_parts_against_all_pairs(monkeypatch):
    fp = far_pairs()
    words = [(fp[:, s] << 36) | (fp[:, s + 1] << 18) | fp[:, s + 2] for s in (0, 3)] + [fp[:, 6], fp[:, 7]]
    block = simhash.Block(np.arange(len(fp)), words, 7, 18)
    monkeypatch.setattr(simhash, "CANDIDATE_COST", 1e9)
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 7)
    for most in (0, 3, 22, 24):
        plan = simhash._plan(block, block, most)
        assert sum(r + 1 for _, _, r in plan) == most + 1 and plan != [(0, 0, 0)]
        a, b = simhash.close_rows(block, block, most, 15)
        assert sorted((x, y) for x, y in zip(a.tolist(), b.tolist()) if x < y) == sorted(all_pairs(fp, most, 15)[0])


def test_default_links_against_all_pairs(docs_of):
    """The groups of the query's own parameters, sketch included, by all pairs."""
    rng = random.Random(12)
    rows = []
    for _ in range(60):
        base = words(rng, rng.randint(30, 80))
        for k in range(4):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 6)):
                w[rng.randrange(len(w))] = words(rng, 1)[0]
            if k == 3 and rng.random() < 0.5:
                rng.shuffle(w)
            rows.append((len(rows), " ".join(w)))
    fp = simhash.fingerprints(pa.array([t for _, t in rows]), simhash.SEGMENTS, simhash.SEGMENT_BITS)
    apart = np.bitwise_count(fp[:, None] ^ fp[None])
    linked = (apart[:, :, :-1].sum(axis=2) <= simhash.MAX_DISTANCE) & (apart[:, :, -1] <= simhash.SKETCH_DISTANCE)
    root = list(range(len(rows)))
    for _ in root:
        for a, b in zip(*np.nonzero(linked)):
            root[a] = root[b] = min(root[a], root[b])
    got = {(r["doc_id"], r["duplicate_of"]) for r in simhash.near_duplicates(docs_of(rows)).collect()}
    assert got == {(i, r) for i, r in enumerate(root) if i != r} and len(got) > 60
    assert (apart[:, :, -1] > simhash.SKETCH_DISTANCE)[apart[:, :, :-1].sum(axis=2) == 0].any()


def test_ids_that_are_texts(spark):
    df = spark.createDataFrame([("b", "x y z"), ("a", "x y z"), ("c", "other words here"), (None, "x y z")], "doc_id string, text string")
    assert [tuple(r) for r in simhash.near_duplicates(df).collect()] == [("b", "a")]


def test_long_texts_in_parts(monkeypatch):
    text = pa.array([" ".join(f"w{k * 7919 % 100_003}" for k in range(60_000)), "short one here"])
    whole = simhash.fingerprints(text, 7, 18)
    monkeypatch.setattr(simhash, "WORDS_AT_ONCE", 1000)
    monkeypatch.setattr(simhash, "PART_WORDS", 700)
    assert (simhash.fingerprints(text, 7, 18) == whole).all()


def plain_votes(text, bits):
    """A fingerprint by loops over whole numbers."""
    votes = [0] * bits
    for word, count in Counter(text.split()).items():
        digest = int.from_bytes(xxhash.xxh128_digest(word), "big")
        for k in range(bits):
            votes[k] += round(4096 * (1 + math.log(count))) * (1 if digest >> (127 - k) & 1 else -1)
    return [v > 0 for v in votes]


def tied_texts(rng, n, repeats=(2, 3, 5)):
    """Texts of few words, of which each count occurs an even number of times, so that many votes are tied."""
    out = []
    for _ in range(n):
        own = words(rng, 2 * rng.randint(3, 12))
        w = [x for k, x in enumerate(own) for _ in range(repeats[k // 2 % len(repeats)])]
        rng.shuffle(w)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("limits", [{}, {"EXACT_FLOAT32": 1 << 16}, {"WORDS_AT_ONCE": 50, "PART_WORDS": 7}])
def test_fingerprints_are_those_of_the_text_alone(monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(simhash, name, value, raising=False)
    rng = random.Random(6)
    texts = tied_texts(rng, 200)
    want = np.array([plain_votes(t, 126) for t in texts])
    for order in (range(200), sorted(range(200), key=lambda _: rng.random())):
        fp = simhash.fingerprints(pa.array([texts[k] for k in order]), 7, 18)[:, :-1]
        assert ((fp[:, :, None] >> np.arange(17, -1, -1) & 1).reshape(200, 126) == want[list(order)]).all()


def test_one_bit_apart_in_each_place(spark):
    rows = [(0, [0] * 7)] + [(1 + s * 18 + p, [(1 << p) if k == s else 0 for k in range(7)]) for s in range(7) for p in range(18)]
    got = {(r["a"], r["b"]) for r in simhash.candidate_pairs(spark.createDataFrame(rows, "id long, fp array<long>"), 7, 18, 1).collect()}
    assert got == {(0, i) for i, _ in rows if i}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    root = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    got = {(r["v"], r["root"]) for r in simhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(v, r) for v, r in root.items() if v != r}


def test_drop_keeps_columns_and_odd_rows(docs_of):
    df = docs_of([(3, "a b c"), (1, "a b c"), (2, None), (None, "a b c"), (4, "")])
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == [1, 2, 4, None]
    assert simhash.drop_near_duplicates(docs_of([])).count() == 0


def test_whole_text_counts():
    long = "same words here " * 50_000
    a, b = simhash.fingerprints(pa.array([long, long + "tail " * 400_000]), 7, 18)
    assert (a != b).any()
