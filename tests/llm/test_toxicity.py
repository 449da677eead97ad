import random

import numpy as np

from cairnlight.llm import toxicity

BAD = ["idiot", "scum", "gravlak"]


def corpus(n, seed=3):
    rng = random.Random(seed)
    parts = ["ba", "do", "ke", "li", "mu", "ra", "so", "ti"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 60))]
        toxic = i % 5 == 0
        if toxic:
            for k in range(0, len(words), 12):
                words[k] = rng.choice(BAD) + (rng.choice(parts) if rng.random() < 0.3 else "")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def brute_model(rows, labels, order):
    """The same model over dictionaries; returns log-likelihoods of a word."""
    from collections import Counter, defaultdict

    counts = [Counter(), Counter()]
    kinds = {i: t for i, _, t in labels}
    for i, text in rows:
        for w in text.lower().split():
            s = toxicity.PAD * (order - 1) + w + toxicity.END
            for k in range(order - 1, len(s)):
                counts[kinds[i]][s[k - order + 1 : k + 1]] += 1

    def discount(c):
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        return min(0.9, max(0.1, n1 / max(1, n1 + 2 * n2)))

    levels = {order: counts[0] + counts[1]}
    for k in range(order - 1, 0, -1):
        c = Counter()
        for g, v in levels[k + 1].items():
            c[g[1:]] += v if g[1] == toxicity.PAD else 1
        levels[k] = c
    stats = {}
    for k, c in levels.items():
        by = defaultdict(lambda: [0, 0])
        for g, v in c.items():
            by[g[:-1]][0] += v
            by[g[:-1]][1] += 1
        stats[k] = (discount(c), by)

    def shared(g):
        k = len(g)
        if k == 0:
            return 1 / (len(levels[1]) + 1)
        d, by = stats[k]
        if g[:-1] not in by:
            return shared(g[1:])
        total, types = by[g[:-1]]
        return max(levels[k][g] - d, 0) / total + d * types / total * shared(g[1:])

    own = []
    for c in counts:
        by = defaultdict(lambda: [0, 0])
        for g, v in c.items():
            by[g[:-1]][0] += v
            by[g[:-1]][1] += 1
        own.append((discount(c), by, c))

    def word(w):
        out = []
        s = toxicity.PAD * (order - 1) + w + toxicity.END
        for d, by, c in (own[1], own[0]):
            total = 0.0
            for k in range(order - 1, len(s)):
                g = s[k - order + 1 : k + 1]
                if g[:-1] in by:
                    n, types = by[g[:-1]]
                    total += np.log(max(c[g] - d, 0) / n + d * types / n * shared(g))
                else:
                    total += np.log(shared(g))
            out.append(total)
        return out

    return word


def test_model_equals_brute_force(spark, docs_of):
    rows, labels = corpus(60)
    model = toxicity.train(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), order=4)
    word = brute_model(rows, labels, 4)
    words = ["bado", "idiot", "idiotle", "zzz", "scum", "k", "gravla"]
    got = model.word_scores(words)
    assert np.allclose(got[:, :2], [word(w) for w in words], atol=1e-3)
    assert got[:, 2].tolist() == [len(w) + 1 for w in words]


def test_held_out_accuracy_and_odd_rows(spark, docs_of):
    rows, labels = corpus(300)
    schema = "doc_id long, quality int, toxic int"
    train = spark.createDataFrame(labels[:200] + [(None, 1, 1), (3, None, None), (3, 1, 0)], schema)
    model = toxicity.train(docs_of(rows[:200] + [(None, "idiot"), (500, None), (501, "")]), train)
    more = [(900, None), (901, ""), (902, "  \n"), (None, "idiot scum idiot scum gravlak idiot"), (903, (rows[201][1] + " ") * 4000)]
    out = toxicity.classify(docs_of(rows[200:] + more), model)
    got = {r["doc_id"]: r["_toxic"] for r in out.collect()}
    truth = {i: bool(t) for i, _, t in labels[200:]}
    assert sum(got[i] == t for i, t in truth.items()) >= 0.97 * len(truth)
    assert not any(got[i] for i in (900, 901, 902, 903)) and got[None]
    assert out.columns[-3:] == ["ll_toxic", "ll_ordinary", "_toxic"]


def test_without_both_classes_nothing_is_toxic(spark, docs_of):
    schema = "doc_id long, quality int, toxic int"
    df = docs_of([(1, "idiot"), (2, "a")])
    for labels in ([], [(1, 1, 1)], [(1, 0, 0), (2, 0, 0)]):
        model = toxicity.train(df, spark.createDataFrame(labels, schema))
        assert model is None
        assert toxicity.classify(df, model, toxic_col="t").where("t").count() == 0
    assert toxicity.train(docs_of([]), spark.createDataFrame([(1, 1, 1)], schema)) is None


def test_joined_labels(spark, docs_of, monkeypatch):
    rows, labels = corpus(60)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a = toxicity.train(docs_of(rows), table)
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 0)
    b = toxicity.train(docs_of(rows), table)
    assert (a.keys == b.keys).all() and np.allclose(a.values, b.values)
    c = toxicity.train(docs_of(rows), table.withColumnRenamed("doc_id", "key"), label_id_col="key")
    assert (a.keys == c.keys).all() and a.threshold == c.threshold


def test_decisions_against_brute_force(spark, docs_of):
    """Threshold and decisions, with the folds, the F1 and the margins by plain loops."""
    from pyspark.sql import functions as F

    rows, labels = corpus(160)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = {r[0] for r in table.where(F.pmod(F.xxhash64("doc_id"), F.lit(toxicity.FOLDS)) == 0).collect()}
    truth = {i: bool(t) for i, _, t in labels}
    prior = np.log(sum(truth.values()) / (len(truth) - sum(truth.values())))

    def margin(word, text):
        got = [word(w) for w in text.lower().split()]
        n = sum(len(w) + 1 for w in text.split())
        return (sum(t for t, _ in got) - sum(o for _, o in got) + prior) / n

    trial = brute_model([r for r in rows if r[0] not in held], labels, 4)
    x = {i: round(margin(trial, t), 4) for i, t in rows if i in held}
    cuts = sorted(set(x.values()))
    f1 = [2 * sum(truth[i] and x[i] >= c for i in x) / (sum(x[i] >= c for i in x) + sum(truth[i] for i in x)) for c in cuts]
    best = f1.index(max(f1))
    threshold = (cuts[best - 1] + cuts[best]) / 2 if best else cuts[0]
    model = toxicity.train(docs_of(rows), table)
    assert abs(model.threshold - threshold) < 2e-4 and np.isclose(model.prior, prior)
    full = brute_model(rows, labels, 4)
    more = corpus(60, seed=8)[0]
    got = {r["doc_id"]: r["_toxic"] for r in toxicity.classify(docs_of(more), model).collect()}
    for i, t in more:
        m = margin(full, t)
        if abs(m - model.threshold) > 1e-3:
            assert got[i] == (m > model.threshold)


def test_large_model_keeps_its_order_and_scores(spark, docs_of):
    rows, labels = corpus(60)
    rows += [(100, None), (101, ""), (102, " \n"), (103, rows[0][1]), (104, "漢字とカナ 한국어 " + "aGVsbG8gd29ybGQ" * 300), (None, "zzz idiot Idiot"), (105, "\U0001f600 x\x02y")]
    df, table = docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    small, large = toxicity.train(df, table), toxicity.train(df, table, max_broadcast_rows=100)
    assert isinstance(small, toxicity.Model) and isinstance(large, toxicity.StoredModel)
    assert large.order == small.order == 4 and abs(large.threshold - small.threshold) < 1e-3
    assert large.rows.count() == len(small.keys)

    def scores(model):
        out = toxicity.classify(df, model)
        assert out.columns == [*df.columns, "ll_toxic", "ll_ordinary", "_toxic"]
        return sorted(((r["doc_id"] or -1, r["ll_toxic"], r["ll_ordinary"], r["_toxic"]) for r in out.collect()))

    a, b = scores(small), scores(large)
    assert [(x[0], x[3]) for x in a] == [(x[0], x[3]) for x in b] and len(a) == len(rows)
    assert np.allclose([x[1:3] for x in a], [x[1:3] for x in b], atol=1e-6)
