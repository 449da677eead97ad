import hashlib
import random
from collections import Counter, defaultdict

from cairnlight.llm import mixing


def mixing_key(i, text):
    """What orders a source's documents."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    return md5(f"{'' if i is None else i}|{md5(text or '')}")


def joined(words):
    """The text of tokens, with None where a document ends."""
    out, start = "", True
    for w in words:
        out += mixing.SEPARATOR if w is None else w if start or w.startswith("\n") else " " + w
        start = w is None
    return out


def tokens(text):
    return text.replace("\n", " \n").split(" ")


def test_every_token_is_in_one_block(docs_of):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(i % 23))) for i in range(120)] + [(None, "n1 n2"), (500, None), (501, ""), (502, " \n\t"), (503, "q\n\nr  s\t" * 3000), (7, "again"), (504, " lead\ntail \n")]
    df = docs_of(rows, source=lambda i: None if i is None or i % 3 == 0 else f"s{i % 2}")
    packed, totals = mixing.blocks(df, 16)
    by, ids = defaultdict(dict), defaultdict(dict)
    for r in packed.collect():
        by[r["src"]][r["block"]], ids[r["src"]][r["block"]] = (r["content"], r["n"]), r["ids"]
        assert r["first"]["doc_id"] == r["ids"][0] and r["first"]["toxic"] == "x"
    streams = defaultdict(list)
    for i, t in sorted(rows, key=lambda r: mixing_key(*r)):
        if t and t.strip(" \t\n\r\f\v"):
            streams["null" if i is None or i % 3 == 0 else f"=s{i % 2}"] += [(w, i) for w in [*tokens(t), None]]
    for src, stream in streams.items():
        assert sorted(by[src]) == list(range(-(-len(stream) // 16)))
        for k, (content, n) in by[src].items():
            part = stream[16 * k : 16 * k + 16]
            assert n == len(part) and content == joined(w for w, _ in part)
            assert list(dict.fromkeys(i for _, i in part)) == list(dict.fromkeys(ids[src][k]))
    assert {r["src"]: r["tokens"] for r in totals.collect()} == {s: len(x) for s, x in streams.items()}


def test_blocks_give_back_their_texts(docs_of):
    text = "one  two\n\nthree \n four" * 40
    content = [r["content"] for r in mixing.blocks(docs_of([(1, text)]), 1 << 20)[0].collect()]
    assert content == [text + mixing.SEPARATOR]


def test_token_ids_and_odd_ids(spark):
    rng = random.Random(6)
    rows = [(f"id-{rng.getrandbits(60):x}", [rng.randrange(1000) for _ in range(rng.randint(0, 30))], f"s{k % 2}", {"a": k}) for k in range(80)] + [(None, [5, 5], "s0", None), ("x", None, "s1", None)]
    df = spark.createDataFrame(rows, "doc_id string, ids array<int>, source string, m map<string,int>")
    out = mixing.mix(df, block=8, shard=10, tokens_col="ids", separator=2, weights={"s0": 1, "s1": 1}).collect()
    want = Counter(t for _, ids, _, _ in rows if ids for t in [*ids, 2])
    once = {(r["source"], r["block"]): r for r in out}
    assert len(out) == sum(-(-sum(len(ids) + 1 for _, ids, s, _ in rows if ids and s == source) // 8) for source in ("s0", "s1"))
    assert all(isinstance(r["text"], list) and len(r["text"]) == r["n_tokens"] for r in out)
    packed, _ = mixing.blocks(df, 8, tokens_col="ids", separator=2)
    assert Counter(t for r in packed.collect() for t in r["content"]) == want and len(once) <= packed.count()


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [(k, o, rng.randrange(9)) for k in "ab" for o in rng.sample(range(500), 120)]
    got = {(r["k"], r["o"]): r["base"] for r in mixing.running_total(spark.createDataFrame(rows, "k string, o long, v long"), "k", "o", "v", 16).collect()}
    assert got == {(k, o): sum(v for k2, o2, v in rows if k2 == k and o2 < o) for k, o, _ in rows}


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100, 257):
        df = spark.range(n).select(F.col("id"), F.lit(n).cast("long").alias("n")).withColumn("k", mixing.round_keys(F.col("n"), 3, "a", 0))
        got = [r[0] for r in df.orderBy("id").select(mixing.permuted(F.col("id"), F.col("n"), F.col("k"), 3, "a", 0)).collect()]
        assert sorted(got) == list(range(n))
        assert n < 50 or got != list(range(n))


def test_weights_and_passes(docs_of):
    df = docs_of([(i, " ".join(["a b c d"] * 8)[:-2]) for i in range(400)], source=lambda i: f"s{i % 4}")
    out = mixing.mix(df, weights={"s0": 6, "s1": 3, "s2": 1, "gone": 5, "s3": 0}, block=32, shard=50).collect()
    n = Counter(r["source"] for r in out)
    assert len(out) == 300 and set(n) == {"s0", "s1", "s2"}
    assert abs(n["s0"] - 180) < 45 and abs(n["s1"] - 90) < 40
    assert sorted(r["slot"] for r in out) == list(range(300)) and all(r["shard"] == r["slot"] // 50 for r in out)
    for source in n:
        used = Counter((r["epoch"], r["block"]) for r in out if r["source"] == source)
        assert max(used.values()) == 1
        passes = Counter(e for e, _ in used)
        assert all(passes[e] == 100 for e in range(max(passes)))


def test_empty_and_same_again(docs_of):
    assert mixing.mix(docs_of([])).count() == 0
    assert mixing.mix(docs_of([(1, None), (2, " ")])).count() == 0
    df = docs_of([(i, f"a{i} b c") for i in range(50)])
    assert sorted(map(tuple, mixing.mix(df, block=4).collect())) == sorted(map(tuple, mixing.mix(df.repartition(3), block=4).collect()))
