"""Toxicity by two class-conditional Kneser-Ney character models.

The labelled documents give counts of character windows inside words (``order``
characters, padded before the word, with a mark after it). A toxic and an
ordinary model discount their own counts and leave the freed mass to one shared
Kneser-Ney model, whose lower orders are continuation counts over both classes.
A window that one class never saw thus costs what the shared counts say, and
contexts that neither class knows tell nothing. Words that occur once, or never
before, are still judged by their parts.

All counts are taken from all labelled rows, as distributed aggregates. The
model that scores holds distinct windows and is broadcast to Python workers. Its
rows are counted first: a model of more than ``max_broadcast_rows`` stays a
stored table by window hash, which the distinct words' windows are joined to.
The order, and with it all scores, are the same either way.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import fresh, stored
from .words import chunks, row_sums, split_words

PAD, END = "\x02", "\x03"
BROADCAST_LABELS = 2_000_000
FOLDS = 5
SCORE_BYTES = 2 << 20
WINDOW_BYTES = 128 << 10
#: Kinds whose rows are at most a few for each character of the alphabet.
SMALL_KINDS = (2, 3, 5)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray, kind: int) -> np.ndarray:
    h = h ^ np.uint64(kind * 0x632BE59BD9B4E019 & (2**64 - 1))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _hashes(cps: np.ndarray, start: int, length: int, count: int) -> np.ndarray:
    """Hashes of ``length`` code points from each of ``count`` places on."""
    h = np.zeros(count, np.uint64)
    for k in range(length):
        h = h * _PRIME + cps[start + k : start + k + count].astype(np.uint64) + np.uint64(1)
    return h


def _code_points(words: list[str], order: int) -> np.ndarray:
    pads = PAD * (order - 1)
    text = pads + (END + pads).join(words) + END
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _places(cps: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a window ends on a character, and the word of each."""
    last = cps[order - 1 :]
    at = np.flatnonzero(last != ord(PAD))
    return at, np.concatenate([[0], np.cumsum(last[at] == ord(END))[:-1]])


def _clean(text: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.replace_substring_regex(text, "[\x02\x03]", " ") if pc.any(pc.match_substring_regex(text, "[\x02\x03]")).as_py() else text)


def _count_windows(order: int):
    names = ["g", "n0", "n1", "n2", "n3"]

    def folded(parts):
        grams, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        found, inverse = np.unique(grams, return_inverse=True)
        return found, np.stack([np.bincount(inverse, counts[:, k], len(found)) for k in range(4)], axis=1)

    def run(batches):
        parts: list = []
        for batch in batches:
            kinds = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for start, text in chunks(batch.column(0)):
                offsets, codes, words = split_words(_clean(text))
                if not len(words):
                    continue
                kind = np.repeat(kinds[start : start + len(text)], np.diff(offsets))
                per_word = np.bincount(codes * 4 + kind, minlength=4 * len(words)).reshape(-1, 4)
                cps = _code_points(words.to_pylist(), order)
                at, owner = _places(cps, order)
                windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(cps, order)[at])
                grams = windows.view(f"<U{order}").ravel()
                hashed = _hashes(cps, 0, order, len(cps) - order + 1)[at]
                _, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
                sums = np.stack([np.bincount(inverse, per_word[owner, k], len(first)) for k in range(4)], axis=1)
                parts.append((grams[first], sums))
                if len(parts) >= 8:
                    parts = [folded(parts)]
        if parts:
            grams, counts = folded(parts)
            for i in range(0, len(grams), 100_000):
                rows = [pa.array(grams[i : i + 100_000].tolist(), pa.string())]
                rows += [pa.array(counts[i : i + 100_000, k].astype(np.int64)) for k in range(4)]
                yield pa.RecordBatch.from_arrays(rows, names)

    return run


def _discount(levels: DataFrame, col: str) -> float:
    n1, n2 = levels.agg(F.sum((F.col(col) == 1).cast("long")), F.sum((F.col(col) == 2).cast("long"))).first()
    return min(0.9, max(0.1, (n1 or 0) / max(1, (n1 or 0) + 2 * (n2 or 0))))


def model_rows(windows: DataFrame, order: int) -> DataFrame:
    """The model as rows (kind, g, a, b); ``windows`` has g and counts t, o.

    Kind 2k holds seen windows of k characters, kind 2k+1 the weights left to
    the next lower order by contexts of k-1 characters. At the top order a and
    b are log values for the toxic and the ordinary class; below, a is shared.
    """

    def prefix(k):
        return F.substring("g", 1, k - 1)

    levels = {order: windows.select("g", (F.col("t") + F.col("o")).alias("c"))}
    for k in range(order - 1, 0, -1):
        tail = F.substring("g", 2, k)
        count = F.when(F.first("p"), F.sum("c")).otherwise(F.count("*")).cast("long")
        levels[k] = levels[k + 1].select(tail.alias("g"), (F.substring("g", 2, 1) == PAD).alias("p"), "c").groupBy("g").agg(count.alias("c"))
        levels[k] = stored(levels[k], f"windows{k}")
    out, lower = [], None
    for k in range(1, order + 1):
        d = _discount(levels[k], "c")
        left = levels[k].groupBy(prefix(k).alias("h")).agg(F.sum("c").alias("cs"), F.count("*").alias("n"))
        left = left.select("h", "cs", (F.lit(d) * F.col("n") / F.col("cs")).alias("w"), "n")
        rows = levels[k].select("g", "c", prefix(k).alias("h")).join(left, "h")
        if lower is None:
            rows = rows.withColumn("below", 1 / (F.col("n") + 1))
            out.append(left.select(F.lit(3).alias("kind"), F.lit("").alias("g"), F.log(F.col("w") / (F.col("n") + 1)).alias("a"), F.lit(0.0).alias("b")))
        else:
            rows = rows.withColumn("s", F.substring("g", 2, k - 1)).join(lower.select(F.col("g").alias("s"), F.col("p").alias("below")), "s")
        lower = stored(rows.select("g", ((F.col("c") - d) / F.col("cs") + F.col("w") * F.col("below")).alias("p")), f"shared{k}")
        if k < order:
            out.append(lower.select(F.lit(2 * k).alias("kind"), "g", F.log("p").alias("a"), F.lit(0.0).alias("b")))
        if 1 < k < order:
            out.append(left.select(F.lit(2 * k + 1).alias("kind"), F.col("h").alias("g"), F.log("w").alias("a"), F.lit(0.0).alias("b")))
    dt, do = (_discount(windows, c) for c in "to")
    sums = [F.sum(c).alias(f"{c}s") for c in "to"] + [F.sum((F.col(c) > 0).cast("long")).alias(f"{c}n") for c in "to"]
    own = windows.groupBy(prefix(order).alias("h")).agg(*sums)
    own = own.select("h", "ts", "os", *[F.when(F.col(f"{c}s") > 0, F.lit(x) * F.col(f"{c}n") / F.col(f"{c}s")).otherwise(1.0).alias(f"{c}w") for c, x in (("t", dt), ("o", do))])
    top = windows.select("g", "t", "o", prefix(order).alias("h")).join(own, "h").join(lower, "g")

    def log_p(c, x):
        kept = F.when(F.col(f"{c}s") > 0, F.greatest(F.col(c) - x, F.lit(0.0)) / F.col(f"{c}s")).otherwise(0.0)
        return F.log(kept + F.col(f"{c}w") * F.col("p"))

    out.append(top.select(F.lit(2 * order).alias("kind"), "g", log_p("t", dt).alias("a"), log_p("o", do).alias("b")))
    both = left.select("h", "w").join(own, "h")
    out.append(both.select(F.lit(2 * order + 1).alias("kind"), F.col("h").alias("g"), F.log(F.col("tw") * F.col("w")).alias("a"), F.log(F.col("ow") * F.col("w")).alias("b")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


@dataclass
class Model:
    """Sorted hashes of all windows and contexts, with their log values."""

    order: int
    keys: np.ndarray
    values: np.ndarray
    threshold: float = 0.0
    prior: float = 0.0

    def look_up(self, hashed: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        h = _mixed(hashed, kind)
        by = np.argsort(h)  # in order, the search stays in the cache
        at = np.empty(len(h), np.int64)
        at[by] = np.searchsorted(self.keys, h[by])
        at = np.minimum(at, len(self.keys) - 1)
        return self.values[at], self.keys[at] == h

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods of each word, toxic and ordinary, and its length."""
        n = self.order
        cps = _code_points(words, n)
        at, owner = _places(cps, n)
        count = len(cps) - n + 1
        value, seen = self.look_up(_hashes(cps, 0, n, count)[at], 2 * n)
        scores = np.where(seen[:, None], value, 0)
        todo = np.flatnonzero(~seen)
        if len(todo):
            left, known = self.look_up(_hashes(cps, 0, n - 1, count)[at[todo]], 2 * n + 1)
            scores[todo] += np.where(known[:, None], left, 0)
            for k in range(n - 1, 0, -1):
                value, seen = self.look_up(_hashes(cps, n - k, k, count)[at[todo]], 2 * k)
                scores[todo[seen]] += value[seen, :1]
                todo = todo[~seen]
                if not len(todo):
                    break
                left, known = self.look_up(_hashes(cps, n - k, k - 1, count)[at[todo]], 2 * k + 1)
                scores[todo] += np.where(known[:, None], left[:, :1], 0)
        return np.stack([np.bincount(owner, scores[:, 0], len(words)), np.bincount(owner, scores[:, 1], len(words)), np.bincount(owner, minlength=len(words))], axis=1)


@dataclass
class StoredModel:
    """The rows of a model too large to broadcast: kind, key, a, b."""

    order: int
    rows: DataFrame
    threshold: float = 0.0
    prior: float = 0.0


def _hash_rows(batches):
    for batch in batches:
        kinds = batch.column(0).to_numpy()
        keys = np.empty(len(kinds), np.uint64)
        for kind in np.unique(kinds):
            at = np.flatnonzero(kinds == kind)
            length = int(kind) // 2 - int(kind) % 2
            grams = "".join(batch.column(1).take(pa.array(at)).to_pylist())
            cps = np.frombuffer(grams.encode("utf-32-le", "replace"), np.uint32).reshape(len(at), length)
            h = np.zeros(len(at), np.uint64)
            for k in range(length):
                h = h * _PRIME + cps[:, k].astype(np.uint64) + np.uint64(1)
            keys[at] = _mixed(h, int(kind))
        values = [batch.column(k).cast(pa.float32()) for k in (2, 3)]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *values], ["key", "a", "b"]).add_column(0, "kind", pa.array(kinds, pa.int32()))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.mapInArrow(_hash_rows, "kind int, key long, a float, b float")


def _read_model(rows: DataFrame, order: int) -> Model:
    """Collect the model as 16 bytes a row; executors hash the windows."""
    table = _hashed(rows).drop("kind").toArrow()
    keys = table["key"].to_numpy().view(np.uint64)
    by = np.argsort(keys)
    values = np.empty((len(by), 2), np.float32)
    for k, name in enumerate("ab"):
        values[:, k] = table[name].to_numpy()[by]
    return Model(order, keys[by], values)


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id_col: str) -> DataFrame:
    """Texts with ``kind``: 2 x toxic + (1 in the fold that is held out)."""
    known = labels.select(F.col(f"`{label_id_col}`").alias("label_id"), "toxic").where("label_id IS NOT NULL AND toxic IS NOT NULL").groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    held = (F.pmod(F.xxhash64("label_id"), F.lit(FOLDS)) == 0).cast("int")
    known = known.select("label_id", ((F.col("toxic") != 0).cast("int") * 2 + held).alias("kind"))
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(known, F.col("id") == F.col("label_id")).select("text", "kind")


def _scorer(model: Model, sc):
    shared = sc.broadcast((model.order, model.keys, model.values))

    @F.arrow_udf("struct<t:double,o:double,n:long>")
    def score(text: pa.Array) -> pa.Array:
        held = Model(*shared.value)
        out = np.zeros((len(text), 3))
        for start, part in chunks(text, SCORE_BYTES):
            offsets, codes, words = split_words(_clean(part))
            if len(words):
                each = held.word_scores(words.to_pylist())
                sums = row_sums(each[codes], offsets)
                out[start : start + len(part)] = sums
        length = np.maximum(out[:, 2], 1)
        return pa.StructArray.from_arrays([pa.array(out[:, 0] / length), pa.array(out[:, 1] / length), pa.array(length.astype(np.int64))], ["t", "o", "n"])

    return score.asNondeterministic()


def _text_words(batches):
    """Rows (text_id, word, c): how often each word occurs in a text."""
    for batch in batches:
        for start, text in chunks(batch.column(1), SCORE_BYTES):
            offsets, codes, words = split_words(_clean(text))
            if len(words):
                row = np.repeat(np.arange(len(text)), np.diff(offsets))
                pairs, counts = np.unique(row * len(words) + codes, return_counts=True)
                ids = batch.column(0).take(pa.array(start + pairs // len(words)))
                yield pa.RecordBatch.from_arrays([ids, words.take(pa.array(pairs % len(words))), pa.array(counts)], ["text_id", "word", "c"])


def _kinds(order: int) -> list[int]:
    """The kinds of rows that a window is looked up in, in this order."""
    return [kind for k in range(order, 0, -1) for kind in (2 * k, 2 * k + 1)]


def _word_windows(order: int):
    """Rows (word_id, window, keys): the windows of a word and their model keys."""

    def run(batches):
        for batch in batches:
            for start, words in chunks(batch.column(1), WINDOW_BYTES):
                cps = _code_points(words.to_pylist(), order)
                at, owner = _places(cps, order)
                count = len(cps) - order + 1
                keys = [_mixed(_hashes(cps, order - k if k < order else 0, k - kind % 2, count)[at], kind) for kind in _kinds(order) for k in [kind // 2]]
                flat = pa.array(np.stack(keys, axis=1).ravel().view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(keys), dtype=np.int32)), flat)
                ids = batch.column(0).take(pa.array(start + owner))
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys[0].view(np.int64)), lists], ["word_id", "window", "keys"])

    return run


def _window_scores(windows: DataFrame, model: StoredModel) -> DataFrame:
    """(window, t, o) by the steps of ``Model.word_scores``, as joins."""
    kinds, n = _kinds(model.order), model.order
    slots = windows.select("window", "keys").dropDuplicates(["window"]).select("window", F.posexplode("keys").alias("slot", "key"))
    slots = slots.withColumn("kind", F.get(F.array(*map(F.lit, kinds)), F.col("slot")))
    few = F.col("kind").isin(*SMALL_KINDS)
    found = slots.where(~few).join(model.rows.where(~few), ["kind", "key"]).unionByName(slots.where(few).join(F.broadcast(model.rows.where(few)), ["kind", "key"]))
    values = [F.max(F.when(F.col("kind") == k, F.col("a").cast("double"))).alias(f"a{k}") for k in kinds]
    values += [F.max(F.when(F.col("kind") == k, F.col("b").cast("double"))).alias(f"b{k}") for k in (2 * n, 2 * n + 1)]
    shared = F.lit(0.0)
    for k in range(1, n):
        shared = F.coalesce(F.col(f"a{2 * k}"), F.coalesce(F.col(f"a{2 * k + 1}"), F.lit(0.0)) + shared)
    t, o = (F.coalesce(F.col(f"{c}{2 * n}"), F.coalesce(F.col(f"{c}{2 * n + 1}"), F.lit(0.0)) + shared) for c in "ab")
    return found.groupBy("window").agg(*values).select("window", t.alias("t"), o.alias("o"))


def _scored_by_joins(df: DataFrame, model: StoredModel, text_col: str, out: str) -> DataFrame:
    """As ``_scorer``, with the model left where it is stored.

    Each distinct word is scored once; equal texts share their sums.
    """
    (key,) = fresh(df, "text_id")
    text_id = F.unhex(F.md5(F.col(text_col)))
    pairs = df.where(F.col(text_col).isNotNull()).select(text_id.alias("text_id"), F.col(text_col).alias("text"))
    pairs = pairs.mapInArrow(_text_words, "text_id binary, word string, c long").groupBy("text_id", "word").agg(F.max("c").alias("c"))
    pairs = stored(pairs.withColumn("word_id", F.unhex(F.md5("word"))), "text_words")
    words = pairs.groupBy("word_id").agg(F.first("word").alias("word"))
    windows = words.mapInArrow(_word_windows(model.order), "word_id binary, window long, keys array<long>")
    each = windows.select("word_id", "window").join(_window_scores(windows, model), "window")
    each = each.groupBy("word_id").agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.count("*").alias("n"))
    texts = pairs.select("text_id", "word_id", "c").join(each, "word_id").groupBy(F.col("text_id").alias(key))
    n = F.sum(F.col("c") * F.col("n"))
    texts = texts.agg(F.struct((F.sum(F.col("c") * F.col("t")) / n).alias("t"), (F.sum(F.col("c") * F.col("o")) / n).alias("o"), n.alias("n")).alias(out))
    none = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("o"), F.lit(1).cast("long").alias("n"))
    scored = df.withColumn(key, text_id).join(texts, key, "left").withColumn(out, F.coalesce(F.col(out), none))
    return scored.drop(key)


def _scored(df: DataFrame, model: Model | StoredModel, text_col: str, out: str) -> DataFrame:
    if isinstance(model, StoredModel):
        return _scored_by_joins(df, model, text_col, out)
    return df.withColumn(out, _scorer(model, df.sparkSession.sparkContext)(F.col(text_col)))


def _margin(s, prior: float):
    """The difference per character, with the prior log odds spread over the text."""
    return s["t"] - s["o"] + F.lit(prior) / s["n"]


def _best_threshold(scored: DataFrame, prior: float) -> float:
    """The middle of the range of thresholds with the best F1 on held-out rows."""
    rows = scored.groupBy(F.round(_margin(F.col("s"), prior), 4).alias("x")).agg(F.sum((F.col("kind") >= 2).cast("long")).alias("t"), F.count("*").alias("n")).orderBy("x").toPandas()
    if not len(rows) or not rows.t.sum() or rows.t.sum() == rows.n.sum():
        return 0.0
    x, t, n = (rows[c].to_numpy(float) for c in "xtn")
    hit, said = np.cumsum(t[::-1])[::-1], np.cumsum(n[::-1])[::-1]
    f1 = 2 * hit / (said + t.sum())
    best = int(np.argmax(f1))
    return float((x[best - 1] + x[best]) / 2) if best else float(x[0])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", order: int = 4, max_broadcast_rows: int = 8_000_000) -> Model | StoredModel | None:
    """Fit both models on all labelled documents; None unless both classes occur.

    The threshold comes from a model of four fifths of the labelled rows, on
    the rest; the returned model counts all of them. A label row with a null is
    ignored; a document with contradicting labels counts as toxic. A model of
    more than ``max_broadcast_rows`` is a ``StoredModel``, with the same scores.
    ``labels`` has the ids of documents in ``label_id_col``.
    """
    labelled = _labelled(docs, labels, id_col, text_col, label_id_col)
    counted = labelled.mapInArrow(_count_windows(order), "g string, n0 long, n1 long, n2 long, n3 long")
    windows = stored(counted.groupBy("g").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "n2", "n3")]), "windows")
    large = 2 * windows.count() > max_broadcast_rows

    def fitted(counts):
        rows = model_rows(counts, order)
        return StoredModel(order, stored(_hashed(rows), "model")) if large else _read_model(rows, order)

    total = windows.agg(F.sum(F.col("n0") + F.col("n1")), F.sum(F.col("n2") + F.col("n3")), F.sum("n0"), F.sum("n2")).first()
    if not total[0] or not total[1]:
        return None
    kinds = {r["kind"] // 2: r["n"] for r in labelled.groupBy((F.floor(F.col("kind") / 2) * 2).cast("int").alias("kind")).agg(F.count("*").alias("n")).collect()}
    prior = math.log(kinds[1] / kinds[0])
    threshold = 0.0
    if total[2] and total[3]:
        part = windows.select("g", F.col("n2").alias("t"), F.col("n0").alias("o")).where("t + o > 0")
        trial = fitted(part)
        threshold = _best_threshold(_scored(labelled.where("kind IN (1, 3)"), trial, "text", "s").select("kind", "s"), prior)
        del trial
    full = windows.select("g", (F.col("n2") + F.col("n3")).alias("t"), (F.col("n0") + F.col("n1")).alias("o"))
    model = fitted(full)
    model.threshold, model.prior = threshold, prior
    return model


def classify(docs: DataFrame, model: Model | StoredModel | None, *, text_col: str = "text", toxic_col: str = "toxic", toxic_ll: str = "ll_toxic", ordinary_ll: str = "ll_ordinary") -> DataFrame:
    """``docs`` with both log-likelihoods per character and the decision.

    A document is toxic if the difference, with the classes' prior log odds
    divided by the length, exceeds the model's threshold. Null,
    empty and blank texts get 0 for both and are never toxic; without a model
    nothing is. Repeated rows are scored alike, whole texts whatever their
    length. Columns of the input keep their names; one that clashes with an
    added column makes the added one take a leading underscore.
    """
    flag, lt, lo, s = fresh(docs, toxic_col, toxic_ll, ordinary_ll, "scores")
    if model is None:
        return docs.withColumns({lt: F.lit(0.0), lo: F.lit(0.0), flag: F.lit(False)})
    blank = F.coalesce(F.regexp_like(F.col(text_col), F.lit(r"^\s*$")), F.lit(True))
    scored = _scored(docs, model, text_col, s)
    return scored.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col(s)["t"].alias(lt),
        F.col(s)["o"].alias(lo),
        (~blank & (_margin(F.col(s), model.prior) > model.threshold)).alias(flag),
    )
