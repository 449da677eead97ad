"""The pipeline and its stages against brute force on small tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from cairnlight.llm import mixing, simhash
from cairnlight.llm.catalog import TOKENIZER

from .conftest import SCHEMA
from .test_line_dedup import brute as brute_lines
from .test_mixing import joined, mixing_key, tokens
from .test_simhash import plain_votes, tied_texts

LABELS = "doc_id long, quality int, toxic int"
PARTS = ["ba", "do", "ke", "li", "mu", "ra", "so", "ti", "vo", "ze"]


def prose(rng, n):
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def corpus(seed=7):
    """Rows, labels, toxic ids, and groups of near duplicates."""
    rng, rows, labels, toxic, groups = random.Random(seed), [], [], set(), []
    for i in range(160):
        w = prose(rng, rng.randint(60, 120))
        if i % 8 == 0:
            toxic.add(i)
            for k in range(0, len(w), 10):
                w[k] = rng.choice(("idiot", "scum", "moron"))
        rows.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, 1, int(i in toxic)))
    for g in range(10):
        base = prose(rng, 150)
        group = []
        for _ in range(rng.randint(2, 4)):
            w = list(base)
            for _ in range(3):
                w[rng.randrange(len(w))] = prose(rng, 1)[0]
            group.append(len(rows))
            rows.append((len(rows), " ".join(w)))
        groups.append(group)
    shared = " ".join(prose(rng, 55))
    rows += [(300 + k, f"{' '.join(prose(rng, 80))}\n{shared}\n{' '.join(prose(rng, 70))}") for k in range(6)]
    return rows, labels, toxic, groups


def write(spark, path, rows, labels):
    data = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


def brute_mix(docs, block, shard, seed=17):
    """Slots of (doc_id, text, source) rows, by plain loops."""
    h = lambda *p: int(hashlib.md5("|".join(map(str, p)).encode()).hexdigest()[:15], 16)
    streams = defaultdict(list)
    for i, text, source in sorted(docs, key=lambda d: mixing_key(*d[:2])):
        if text and text.strip():
            streams[f"={source}"] += [(w, i) for w in [*tokens(text), None]]
    streams = dict(sorted(streams.items()))
    weight = {s: max(1, math.isqrt(len(w))) for s, w in streams.items()}
    size = {s: -(-len(w) // block) for s, w in streams.items()}
    count, used, out = sum(size.values()), Counter(), []
    for shard_no in range(-(-count // shard)):
        drawn = Counter()
        for slot in range(shard_no * shard, min(count, (shard_no + 1) * shard)):
            u = h(seed, "draw", slot) % sum(weight.values())
            for s in streams:
                if u < weight[s]:
                    break
                u -= weight[s]
            drawn[s] += 1
        for s, c in drawn.items():
            for _ in range(c):
                epoch, x = divmod(used[s], size[s])
                used[s] += 1
                for r in range(1, mixing.ROUNDS + 1):
                    other = (h(seed, s, epoch, r) % size[s] - x) % size[s]
                    if h(seed, s, epoch, r, max(x, other)) % 2:
                        x = other
                words = streams[s][x * block : (x + 1) * block]
                out.append((words[0][1], joined(w for w, _ in words), s[1:]))
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rows, labels, toxic, groups = corpus()
    path = write(spark, tmp_path_factory.mktemp("sf"), rows, labels)
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    seen.append(docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/stage{k}")
        docs = spark.read.parquet(f"{path}/stage{k}")
        seen.append(docs)
    return path, seen, (rows, toxic, groups)


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "sentencepiece"]
    _, seen, _ = stages
    assert all(df.dtypes == seen[0].dtypes for df in seen[1:-1])


def test_toxic_documents_go(stages):
    _, seen, (rows, toxic, _) = stages
    assert pairs(seen[1]) == sorted(r for r in rows if r[0] not in toxic)


def test_repeated_lines_go(stages):
    _, seen, _ = stages
    want = [(i, t) for i, t, gone in brute_lines(pairs(seen[1])) if not gone or t.strip()]
    assert pairs(seen[2]) == sorted(want)
    assert all(r["n_chars"] == len(r["text"]) for r in seen[2].collect())


def test_one_of_each_group_stays(stages):
    _, seen, (_, _, groups) = stages
    gone = {i for g in groups for i in g[1:]}
    assert pairs(seen[3]) == [p for p in pairs(seen[2]) if p[0] not in gone]


def test_near_duplicates_without_a_segment_in_common(spark, docs_of):
    """The stage drops what is linked at its distances by whole fingerprints only."""
    rng, rows = random.Random(12), []
    for _ in range(60):
        base = prose(rng, rng.randint(40, 90))
        for _ in range(2):
            w = list(base)
            for _ in range(len(w) // 10):
                w[rng.randrange(len(w))] = prose(rng, 1)[0]
            rows.append((len(rows), " ".join(w)))
    fp = simhash.fingerprints(pa.array([t for _, t in rows]), simhash.SEGMENTS, simhash.SEGMENT_BITS)
    apart = np.bitwise_count(fp[:, None] ^ fp[None])
    linked = (apart[:, :, :-1].sum(axis=2) <= simhash.MAX_DISTANCE) & (apart[:, :, -1] <= simhash.SKETCH_DISTANCE)
    pairs_ = [(a, b) for a, b in zip(*np.nonzero(linked)) if a < b]
    assert any(apart[a, b, :-1].min() > 1 for a, b in pairs_) and all(a // 2 == b // 2 for a, b in pairs_)
    left = corpus_pipeline.drop_near_duplicates(spark, docs_of(rows), "")
    assert pairs(left) == [r for r in rows if r[0] not in {b for _, b in pairs_}]


def test_near_duplicates_with_tied_votes(spark, docs_of):
    """A link doesn't depend on the texts that share a batch: votes are those of plain loops."""
    rng, both = random.Random(23), []
    for text in tied_texts(random.Random(22), 3000):
        w = text.split()
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = prose(rng, 1)[0]
        both.append((text, " ".join(w)))
    fp = [simhash.fingerprints(pa.array(side), simhash.SEGMENTS, simhash.SEGMENT_BITS) for side in zip(*both)]
    apart = np.bitwise_count(fp[0] ^ fp[1])
    edge = (abs(apart[:, :-1].sum(axis=1) - simhash.MAX_DISTANCE) <= 1) & (apart[:, -1] <= simhash.SKETCH_DISTANCE)
    texts = [t for k in np.flatnonzero(edge) for t in both[k]]
    bits = np.array([plain_votes(t, 126) for t in texts])
    sketch = simhash.fingerprints(pa.array(texts), simhash.SEGMENTS, simhash.SEGMENT_BITS)[:, -1]
    near = ((bits[:, None] != bits[None]).sum(axis=2) <= simhash.MAX_DISTANCE) & (np.bitwise_count(sketch[:, None] ^ sketch[None]) <= simhash.SKETCH_DISTANCE)
    linked = [(a, b) for a, b in zip(*np.nonzero(near)) if a < b]
    assert len(linked) > 10 and all(a // 2 == b // 2 for a, b in linked)
    left = corpus_pipeline.drop_near_duplicates(spark, docs_of(list(enumerate(texts))), "")
    assert [i for i, _ in pairs(left)] == [i for i in range(len(texts)) if i not in {b for _, b in linked}]


def test_mixture_against_loops(stages):
    _, seen, _ = stages
    docs = [(r["doc_id"], r["text"], r["source"]) for r in seen[3].collect()]
    got = sorted((r["doc_id"], r["text"], r["source"]) for r in seen[4].collect())
    assert got == sorted(brute_mix(docs, mixing.BLOCK, mixing.SHARD)) and len(got) > 15


def test_encoding_round_trip(stages):
    _, seen, _ = stages
    library = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    rows = seen[5].collect()
    texts = Counter(r["text"] for r in seen[4].collect())
    assert all(r["round_trip"] for r in rows)
    assert Counter(library.decode(list(r["ids"])) for r in rows if r["rank"] == 1) == texts
    assert len(rows) == 4 * sum(texts.values())


def test_run_is_the_stages(spark, stages):
    path, seen, _ = stages
    key = lambda r: (r["doc_id"], r["rank"], tuple(r["ids"]))
    assert sorted(map(key, corpus_pipeline.run(spark, path).collect())) == sorted(map(key, seen[5].collect()))


@pytest.mark.parametrize("rows", [[], [(None, None), (1, None), (2, ""), (2, ""), (None, "a b"), (3, "x " * 50_000), (3, "x " * 50_000), (4, "\n\n")]])
def test_odd_tables(spark, tmp_path, rows):
    path = write(spark, tmp_path, rows, [])
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "'x' AS toxic", "1 AS removed_lines", "'y' AS rank")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    found = docs.collect()
    assert bool(found) == bool(rows)
    assert corpus_pipeline.encode(spark, docs, path).count() >= len(found)
