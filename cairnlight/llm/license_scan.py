"""Licence scan: a trained paragraph classifier, confirmed by templates.

A paragraph is a run of lines that hold words; comment marks alone make no word.
It becomes sparse word 1- and 2-grams, scaled by the square root of their
number. Multinomial logistic regression predicts a licence family or
``unknown``. So that a notice is found inside other text too, every line of a
paragraph of several, and overlapping windows of a long one, are scored as well;
a paragraph that is confirmed as a whole speaks for its parts. The model is trained on the driver from licence
paragraphs and notices, with words dropped, swapped in and cut, and from a
bounded sample of the corpus for the unknown class, without what looks like a
licence itself. A held-out part calibrates it: a temperature for the
probabilities, then the least probability at which predictions are right. A
prediction is confirmed if enough of its n-grams occur in the family's templates.

Only n-grams of the training licences are features; the model is a few
thousand rows, broadcast whatever the corpus. Every paragraph of every document
is scored.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import NAMES, NOTICES, OTHER, PASSAGES, SPDX
from .words import chunks, row_sums, split_words

UNKNOWN = "unknown"
BACKGROUND_DOCS = 400
BACKGROUND_LINES = 2500
LIKE_A_LICENCE = 0.3
WINDOW = 64
SCRAMBLED = 400
CONFIRM_AT = 0.6
LEAST_SHARED = 3
PRECISION = 0.99
_EDGES = re.compile(r"^[^a-z0-9]+|[^a-z0-9+]+$")


def normalized(word: str) -> str:
    return _EDGES.sub("", word.lower())


def tokens(text: str) -> list[str]:
    return [w for w in map(normalized, text.split()) if w]


def templates() -> dict[str, list[str]]:
    families = {*NAMES, *PASSAGES}
    return {
        f: [p.format(n=n) for n in NAMES.get(f, []) for p in NOTICES] + [f"SPDX-License-Identifier: {i}" for i in SPDX.get(f, [])] + PASSAGES.get(f, [])
        for f in sorted(families)
    }


def examples(background: list[str], seed: int = 5) -> list[tuple[str, str]]:
    """(text, family) pairs, varied; background lines are of the unknown class."""
    rng = random.Random(seed)
    filler = [w for line in background[:200] for w in line.split()] or ["lorem", "ipsum"]
    out = []
    for family, texts in templates().items():
        for text in texts:
            out.append((text, family))
            long = len(text.split()) > 30
            for _ in range(3 if len(texts) > 20 and not long else 14):
                words = [w for w in text.split() if rng.random() > 0.06]
                if len(words) > 14 and rng.random() < 0.5:
                    at = rng.randrange(len(words) - 11)
                    words = words[at : at + rng.randint(11, len(words) - at)]
                extra = [rng.choice(filler) for _ in range(rng.choice((0, 0, 1, 3, 6)))]
                out.append((" ".join(words + extra if rng.random() < 0.5 else extra + words), family))
    # words of licences in no order of theirs belong to none
    loose = sorted({w for texts in templates().values() for t in texts for w in t.split()})
    for _ in range(SCRAMBLED):
        words = [rng.choice(loose) for _ in range(rng.randint(1, 8))] + [rng.choice(filler) for _ in range(rng.randint(2, 12))]
        rng.shuffle(words)
        out.append((" ".join(words), UNKNOWN))
    for text in OTHER:
        out += [(text, UNKNOWN)] * 2
        out += [(" ".join([w for w in text.split() if rng.random() > 0.1] + [rng.choice(filler) for _ in range(3)]), UNKNOWN) for _ in range(6)]
    return out + [(line, UNKNOWN) for line in background]


@dataclass
class Classifier:
    classes: list[str]
    words: dict[str, int]
    pairs: np.ndarray
    weights: np.ndarray
    inside: np.ndarray
    temperature: float
    threshold: float

    def features(self, ids: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(line, feature) of every known n-gram, with repeats; ``ids`` are -1 for other words."""
        known = np.flatnonzero(ids >= 0)
        a, b = ids[:-1], ids[1:]
        both = np.flatnonzero((a >= 0) & (b >= 0) & (line[:-1] == line[1:]))
        code = a[both] * len(self.words) + b[both]
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        hit = self.pairs[at] == code
        return np.concatenate([line[known], line[both[hit]]]), np.concatenate([ids[known], at[hit] + len(self.words)])

    def distinct(self, ids: np.ndarray, line: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known n-grams once for each line, by line, and the lines' n-grams in all."""
        rows, cols = self.features(ids, line)
        width = self.inside.shape[1]
        once = np.unique(rows * width + cols)
        repeats = np.bincount(rows, minlength=lines) - np.bincount(once // width, minlength=lines)
        return once // width, once % width, np.maximum(2 * np.bincount(line, minlength=lines) - 1 - repeats, 1)

    def scores(self, ids: np.ndarray, line: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, probability and template similarity of every line."""
        rows, cols, grams = self.distinct(ids, line, lines)
        offsets = np.searchsorted(rows, np.arange(lines + 1))
        logits = row_sums(self.weights[cols], offsets) / np.sqrt(grams)[:, None] + self.weights[-1]
        logits = logits / self.temperature
        top = logits.argmax(axis=1)
        chance = 1 / np.exp(logits - logits.max(axis=1, keepdims=True)).sum(axis=1)
        held = self.inside[np.repeat(top, np.diff(offsets)), cols]
        shared = row_sums(held.astype(np.float64), offsets)
        return top, chance, np.where(shared >= LEAST_SHARED, shared, 0) / grams


def _unlike(model: Classifier, texts: list[str]) -> list[str]:
    """The texts of whose n-grams no family's templates hold LIKE_A_LICENCE or more."""
    lists = [tokens(t) for t in texts]
    ids = np.array([model.words.get(w, -1) for x in lists for w in x], np.int64)
    rows, cols, grams = model.distinct(ids, np.repeat(np.arange(len(lists)), [len(x) for x in lists]), len(lists))
    shared = np.stack([np.bincount(rows, own[cols], len(lists)) for own in model.inside], axis=1).max(axis=1)
    return [t for t, x, s in zip(texts, lists, (shared >= LEAST_SHARED) * shared / grams) if x and s < LIKE_A_LICENCE]


def _vocabulary(texts: list[str]) -> tuple[dict[str, int], np.ndarray]:
    lists = [tokens(t) for t in texts]
    words = {w: i for i, w in enumerate(sorted({w for x in lists for w in x}))}
    pairs = {words[a] * len(words) + words[b] for x in lists for a, b in zip(x, x[1:])}
    return words, np.array(sorted(pairs), np.int64)


def fit(background: list[str], *, rounds: int = 300, seed: int = 5) -> tuple[Classifier, dict[str, float]]:
    """The classifier, and its accuracy and precision on the held-out quarter."""
    own = templates()
    words, pairs = _vocabulary([t for texts in own.values() for t in texts] + OTHER)
    classes = [*sorted(own), UNKNOWN]
    model = Classifier(classes, words, pairs, np.zeros((len(words) + len(pairs) + 1, len(classes)), np.float32), np.zeros((len(classes), len(words) + len(pairs)), bool), 1.0, 0.0)
    for f, texts in own.items():
        lists = [tokens(t) for t in texts]
        flat = np.array([words[w] for x in lists for w in x], np.int64)
        line = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        model.inside[classes.index(f), model.features(flat, line)[1]] = True
    data = examples(_unlike(model, background), seed)
    random.Random(seed + 1).shuffle(data)
    lists = [tokens(t) for t, _ in data]
    ids = np.array([words.get(w, -1) for x in lists for w in x], np.int64)
    line = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    rows, cols, grams = model.distinct(ids, line, len(data))
    x = np.zeros((len(data), len(words) + len(pairs) + 1), np.float32)
    x[rows, cols] = 1
    x /= np.sqrt(grams)[:, None]
    x[:, -1] = 1
    y = np.array([classes.index(f) for _, f in data])
    held = np.arange(len(data)) % 4 == 3
    counts = np.bincount(y[~held], minlength=len(classes))
    balance = (1 / np.sqrt(np.maximum(counts, 1)))[y[~held]][:, None].astype(np.float32)
    balance /= balance.mean()
    a, one = x[~held], np.eye(len(classes), dtype=np.float32)[y[~held]]
    w, speed = model.weights, np.zeros_like(model.weights)
    for _ in range(rounds):
        z = a @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed - 4.0 * (a.T @ ((p - one) * balance) / len(a) + 2e-5 * w)
        w = w + speed
    model.weights = w
    z, truth = x[held] @ w, y[held]

    def log_loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean())

    model.temperature = min(np.geomspace(0.2, 5, 41), key=log_loss)
    s = z / model.temperature
    p = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
    said = s.argmax(axis=1)
    named = said != len(classes) - 1
    by = np.argsort(-p[named])
    right = (said == truth)[named][by]
    precise = np.cumsum(right) / np.arange(1, len(right) + 1) >= PRECISION
    last = int(np.flatnonzero(precise)[-1]) if precise.any() else 0
    model.threshold = float(p[named][by][last])
    kept = named & (p >= model.threshold)
    return model, {"accuracy": float((said == truth).mean()), "precision": float((said == truth)[kept].mean()), "recall": float((kept & (said == truth))[truth != len(classes) - 1].sum() / max(1, (truth != len(classes) - 1).sum()))}


def background_lines(docs: DataFrame, id_col: str, text_col: str, most_docs: int = BACKGROUND_DOCS, most_lines: int = BACKGROUND_LINES) -> list[str]:
    """Lines of ``most_docs`` documents at most, the first by a hash of id.

    Long lines are cut in windows; of all these, ``most_lines`` are taken by hash.
    """
    text = F.col(f"`{text_col}`")
    h = F.xxhash64(F.col(f"`{id_col}`"), F.length(text))
    known = docs.where(text.isNotNull())
    # hashes alone are sorted first, so that few texts reach the one task that limits
    bound = known.select(h.alias("h")).orderBy("h").limit(most_docs).agg(F.max("h")).first()[0]
    chosen = known.where(h <= F.lit(bound).cast("long")).select(h.alias("h"), text.alias("t")).orderBy("h", "t").limit(most_docs)
    words = chosen.select(F.explode(F.split("t", "\n")).alias("l")).where(F.regexp_like("l", F.lit(r"\S"))).select(F.split("l", r"\s+").alias("w"))
    parts = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(WINDOW)), lambda i: F.array_join(F.slice("w", i, WINDOW), " "))).alias("l"))
    return sorted(r[0] for r in parts.orderBy(F.xxhash64("l"), "l").limit(most_lines).collect())


def _best(found: list[np.ndarray]) -> np.ndarray:
    """Of (paragraph, line, class, probability, similarity) rows the best for each paragraph and class."""
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 1], -rows[:, 3], -rows[:, 4], rows[:, 2], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 2] != rows[:-1, 2])
    return rows[first]


def licences(model: Classifier, ids: np.ndarray, line: np.ndarray, doc_of_line: np.ndarray, confirm_at: float) -> np.ndarray:
    """Rows (line of the paragraph, line, class, probability, similarity).

    ``ids`` are the words' numbers (-1 for others) and ``line`` their lines;
    ``doc_of_line`` tells which lines go together.
    """
    if not len(ids):
        return np.empty((0, 5))
    held = np.unique(line)
    fresh = np.ones(len(held), bool)
    fresh[1:] = (held[1:] != held[:-1] + 1) | (doc_of_line[held[1:]] != doc_of_line[held[:-1]])
    paragraph_of_line = np.full(len(doc_of_line), -1)
    paragraph_of_line[held] = np.cumsum(fresh) - 1
    begins = held[fresh]
    paragraph = paragraph_of_line[line]
    starts = np.searchsorted(paragraph, np.arange(len(begins) + 1))
    unknown, found = len(model.classes) - 1, []

    def score(mask, unit):
        """Add what is found in the units of some words; the paragraphs confirmed."""
        own, numbers = np.flatnonzero(mask), None
        numbers, first, unit = np.unique(unit[own], return_index=True, return_inverse=True)
        top, chance, similar = model.scores(ids[own], unit, len(numbers))
        hit = np.flatnonzero((top != unknown) & (chance >= model.threshold))
        at = own[first[hit]]
        found.append(np.stack([paragraph[at], line[at], top[hit], chance[hit], similar[hit]], axis=1))
        return paragraph[at][similar[hit] >= confirm_at]

    rest = np.ones(len(begins), bool)
    rest[score(np.ones(len(ids), bool), paragraph)] = False
    rest = rest[paragraph]
    place, size = np.arange(len(ids)) - starts[paragraph], np.diff(starts)[paragraph]
    several = line[starts[paragraph + 1] - 1] != line[starts[paragraph]]
    if (rest & several).any():
        score(rest & several, line)
    for shift in (0, WINDOW // 2):
        if (rest & (size > WINDOW)).any():
            score(rest & (size > WINDOW), paragraph * (len(ids) // (WINDOW // 2) + 2) + (place + shift) // WINDOW)
    rows = _best(found)
    rows[:, 0] = begins[rows[:, 0].astype(np.int64)]
    return rows


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", confirm_at: float = CONFIRM_AT, model: Classifier | None = None, background_docs: int = BACKGROUND_DOCS, background_lines_most: int = BACKGROUND_LINES) -> DataFrame:
    """(id, paragraph, line, family, probability, similarity, confirmed) of licences.

    A paragraph is a run of lines with words, named by the number of its first
    line, from 1; ``line`` is where the part begins that was recognised. There
    is a row for each family in a paragraph, for the part most like it.
    Parts are the whole paragraph; unless that is confirmed, also each of several
    lines, and windows of WINDOW words, every half of one, if it is longer. Parts
    that the classifier gives to ``unknown``, or to a family below the
    calibrated probability, are left out. ``confirmed`` means that at least
    ``confirm_at`` of the part's n-grams occur in the family's templates; fewer
    than LEAST_SHARED such n-grams count as none. Without a ``model`` one is
    fitted, with ``background_lines_most`` lines of ``background_docs`` documents
    at most for the unknown class.

    Defined cases: null, empty and blank texts and lines have no licence. Equal
    rows give equal results; null ids stay. Lines and texts are read whole. On
    a tie the family that comes first in the alphabet wins. Without any
    documents the unknown class is trained from built-in sentences alone. Other
    columns are not looked at.
    """
    spark = docs.sparkSession
    if model is None:
        model = fit(background_lines(docs, id_col, text_col, background_docs, background_lines_most))[0]
    parts = (model.classes, model.words, model.pairs, model.weights, model.inside, float(model.temperature), model.threshold)
    shared = spark.sparkContext.broadcast(parts)
    names = [id_col, "paragraph", "line", "family", "probability", "similarity", "confirmed"]

    def run(batches):
        held = Classifier(*shared.value)
        for batch in batches:
            for start, text in chunks(batch.column(1)):
                lists = pc.split_pattern(pc.fill_null(text, ""), "\n")
                first = lists.offsets.to_numpy().astype(np.int64)
                first -= first[0]
                offsets, codes, found = split_words(lists.flatten())
                if not len(found):
                    continue
                plain = [normalized(w) for w in found.to_pylist()]
                known = np.array([held.words.get(w, -1) if w else -2 for w in plain], np.int64)[codes]
                line = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                full = known != -2
                rows = licences(held, known[full], line[full], np.repeat(np.arange(len(text)), np.diff(first)), confirm_at)
                if len(rows):
                    where = rows[:, :2].astype(np.int64)
                    row = np.searchsorted(first, where[:, 0], side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(row + start)),
                            *[pa.array((where[:, k] - first[row] + 1).astype(np.int32)) for k in (0, 1)],
                            pa.array([held.classes[int(t)] for t in rows[:, 2]]),
                            *[pa.array(np.round(rows[:, k], 6)) for k in (3, 4)],
                            pa.array(rows[:, 4] >= confirm_at),
                        ],
                        names,
                    )

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, paragraph int, line int, family string, probability double, similarity double, confirmed boolean")
