"""SentencePiece encoding with N-best segmentation, and decoding.

The lattice of a text has an edge for every vocabulary piece that matches. The
N best paths come from two passes: Viterbi scores from the front, then A* from
the back, which takes those scores as its heuristic. They are exact, so every
path leaves the queue complete and in order, and nothing is expanded in vain.

No piece crosses from a letter to a space mark, nor holds a line break, so all
paths of a text meet there and the lattice falls into segments. Distinct
segments of a batch are scored together in numpy, each with its best path and
the loss of its second. A text's N best can differ from its best only in the
N - 1 segments with the least second losses; A* runs on those alone, and their
lists are merged. That is exact for the text as a whole.

Scores are whole multiples of 2**-30, so that sums are exact and equal scores
are equal in whatever order a path was added up.

Piece scores are the model's own for unigram models. A BPE model has merge
ranks instead, which don't add up along a path. Its best path is the one that
its merges give, as by the library: pieces on that path cost nothing, any other
one its Zipf log probability, -log(rank + 1) - log(log(size)). So the N best are
the tokenizer's own segmentation, with score 0, and those that leave it at the
least cost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import chunks

SPACE = "▁"
NBEST = 4
UNKNOWN_PENALTY = 10.0
SCALE = 1 << 30
NONE = -(1 << 60)
VECTOR_LENGTH = 48
CHUNK_BYTES = 4 << 20
GROUP_ROWS = 256
KNOWN_SEGMENTS = 1 << 18
KNOWN_IDS = 1 << 21
EDGE_VALUES = 3_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
NORMAL, USER_DEFINED, BYTE = 1, 4, 6


def read_model(path: str) -> dict:
    """Plain tables of a model file, small enough to broadcast (about 2 MB)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model_tables(model)


def model_tables(model) -> dict:
    """As ``read_model``, of a parsed model."""
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only models with the identity normalizer are supported")
    if model.trainer_spec.treat_whitespace_as_suffix or not model.trainer_spec.byte_fallback:
        raise ValueError("only models with space prefixes and byte fallback are supported")
    bpe = model.trainer_spec.model_type == 2
    shift = math.log(math.log(max(3, len(model.pieces))))
    best = max((p.score for p in model.pieces if p.type == NORMAL), default=0.0)
    scores, surface, pieces, byte_ids, lengths = {}, [], {}, {}, []
    for i, p in enumerate(model.pieces):
        surface.append(b"")
        lengths.append(len(p.piece))
        if p.type in (NORMAL, USER_DEFINED):
            if any(a != SPACE and b == SPACE for a, b in zip(p.piece, p.piece[1:])) or ("\n" in p.piece and len(p.piece) > 1):
                raise ValueError("a piece crosses a segment's edge")
            pieces[p.piece] = i
            score = p.score if p.type == NORMAL else len(p.piece) * best - 0.1
            scores[i] = round(SCALE * (-math.log(max(0.0, -p.score) + 1) - shift if bpe else score))
            surface[i] = p.piece.replace(SPACE, " ").encode()
        elif p.type == BYTE:
            value = int(p.piece[3:5], 16)
            byte_ids[value] = i
            surface[i] = bytes([value])
            lengths[i] = int(not 0x80 <= value < 0xC0)  # a character counts at its first byte
    prefix = bool(spec.add_dummy_prefix)
    library = None
    if bpe:
        own = type(model)()
        own.CopyFrom(model)
        own.normalizer_spec.add_dummy_prefix = False
        library = own.SerializeToString()
    return {
        "pieces": pieces, "scores": scores, "surface": surface, "bytes": [byte_ids[b] for b in range(256)], "lengths": lengths, "library": library,
        "unknown": min(scores.values()) - round(UNKNOWN_PENALTY * SCALE), "longest": max(map(len, pieces)), "prefix": prefix,
    }


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_PRIME) + ord(c) + 1) & (2**64 - 1)
    return h


class _Starts:
    """Where the pieces of an open path start, from the back; ordered as lists.

    Paths share their tails; two of them are compared from where they part.
    """

    __slots__ = ("rest", "at", "depth")

    def __init__(self, rest: _Starts | None, at: int):
        self.rest, self.at, self.depth = rest, at, rest.depth + 1 if rest else 0

    def __lt__(self, other: _Starts) -> bool:
        a, b = self, other
        while a.depth > b.depth:
            a = a.rest
        while b.depth > a.depth:
            b = b.rest
        if a is b:
            return self.depth < other.depth
        while a.rest is not b.rest:
            a, b = a.rest, b.rest
        return a.at < b.at


class Lattice:
    """Searches over segments, for one model."""

    def __init__(self, model: dict):
        self.pieces, self.scores, self.bytes = model["pieces"], model["scores"], model["bytes"]
        self.unknown, self.longest, self.prefix = model["unknown"], model["longest"], model["prefix"]
        self.surface = pa.array(model["surface"], pa.binary())
        names = list(self.pieces)
        keys = np.array([_hash(p) for p in names], np.uint64)
        by = np.argsort(keys)
        self.keys, self.ids = keys[by], np.array([self.pieces[p] for p in names], np.int32)[by]
        self.piece_scores = np.array([self.scores[int(i)] for i in self.ids], np.int64)
        self.lengths = np.array(model["lengths"], np.int64)
        self.library = None
        if model["library"] is not None:
            from sentencepiece import SentencePieceProcessor

            self.library = SentencePieceProcessor(model_proto=model["library"])
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True
        self.singles = {c for c in self.pieces if len(c) == 1}
        self.powers = np.array([pow(int(_PRIME), k, 2**64) for k in range(self.longest + 1)], np.uint64)
        self.known: dict[str, int] = {}
        self.kept: tuple[np.ndarray, ...] | None = None
        self.nbest = lru_cache(1 << 14)(self._nbest)

    def merged(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where each segment's pieces by merges end, and their lengths.

        Ends count through all segments joined. Without merges there are none.
        """
        if self.library is None or not segments:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        sizes = self.lengths[np.fromiter(chain.from_iterable(self.library.encode(segments, num_threads=1)), np.int64)]
        sizes = sizes[sizes > 0]
        if sizes.sum() != sum(map(len, segments)):
            raise ValueError("the library's pieces don't cover the text")
        return np.cumsum(sizes), sizes

    def edges_to(self, text: str, end: int, own: int) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(start, score, ids) of the edges to ``end``; ``own`` is the length of the one by merges."""
        for start in range(max(0, end - self.longest), end):
            piece = self.pieces.get(text[start:end])
            if piece is not None:
                yield start, 0 if end - start == own else self.scores[piece], (piece,)
        if text[end - 1] not in self.singles:
            yield end - 1, 0 if own == 1 else self.unknown, tuple(self.bytes[b] for b in text[end - 1].encode())

    def _nbest(self, text: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` best paths as (score, ids), best first.

        Of equal scores that with the longer last piece comes first, then with
        the longer one before it, and so on. As the heuristic is exact, each
        open path stands for a whole one of its score and place in that order.
        So no more of them are kept than paths are still wanted.
        """
        own = dict(zip(*(x.tolist() for x in self.merged([text]))))
        forward = [0] + [NONE] * len(text)
        for end in range(1, len(text) + 1):
            forward[end] = max(forward[s] + x for s, x, _ in self.edges_to(text, end, own.get(end, 0)))
        out: list[tuple[int, tuple[int, ...]]] = []
        queue: list[tuple] = [(-forward[-1], _Starts(None, len(text)), 0, (), None)]
        while queue and len(out) < n:
            _, starts, done, ids, tail = queue.pop(0)
            at = starts.at
            if at == 0:
                found = list(ids)
                while tail is not None:
                    found += tail[0]
                    tail = tail[1]
                out.append((done, tuple(found)))
                continue
            for start, score, taken in self.edges_to(text, at, own.get(at, 0)):
                total = done + score
                queue.append((-(total + forward[start]), _Starts(starts, start), total, taken, (ids, tail)))
            queue.sort(key=lambda p: p[:2])
            del queue[n - len(out) :]
        return out

    def best(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each segment: offsets into ids, ids, score, and the second's loss.

        Results of up to KNOWN_SEGMENTS segments are kept for later calls.
        """
        new = [s for s in segments if s not in self.known]
        offsets, flat, score, loss = self._best(new)
        if self.kept is not None:
            old = self.kept
            offsets = np.concatenate([old[0], old[0][-1] + offsets[1:]])
            flat, score, loss = (np.concatenate([a, b]) for a, b in zip(old[1:], (flat, score, loss)))
        places = self.known | {s: len(self.known) + k for k, s in enumerate(new)}
        at = np.fromiter(map(places.__getitem__, segments), np.int64, len(segments))
        sizes = np.diff(offsets)[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = ends, flat[np.repeat(offsets[:-1][at] - ends[:-1], sizes) + np.arange(ends[-1])], score[at], loss[at]
        if len(places) <= KNOWN_SEGMENTS and len(flat) <= KNOWN_IDS:
            self.known, self.kept = places, (offsets, flat, score, loss)
        return out

    def _best(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        count = len(segments)
        lengths = np.fromiter(map(len, segments), np.int64, count)
        score, loss = np.zeros(count, np.int64), np.full(count, -NONE)
        counts = np.zeros(count, np.int64)
        ends, sizes = self.merged(segments)
        own = np.zeros(lengths.sum() + 1, np.int64)  # the length of the piece by merges that ends before a character
        own[ends] = sizes
        begins = np.cumsum(lengths) - lengths
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        plain = np.zeros(count, bool)
        for length in np.unique(lengths[lengths <= VECTOR_LENGTH]):
            rows = np.flatnonzero(lengths == length)
            if length and len(rows) >= 8:
                plain[rows] = True
                most = max(64, EDGE_VALUES // int(length * min(length, self.longest)))
                for lo in range(0, len(rows), most):
                    part = rows[lo : lo + most]
                    score[part], loss[part], ids, counts[part] = self._vector_best([segments[i] for i in part], int(length), own[begins[part][:, None] + np.arange(length + 1)])
                    parts.append((part, ids))
        for i in np.flatnonzero(~plain & (lengths > 0)):
            paths = self.nbest(segments[i], 2)
            score[i], counts[i] = paths[0][0], len(paths[0][1])
            loss[i] = paths[0][0] - paths[1][0] if len(paths) > 1 else -NONE
            parts.append((np.array([i]), np.array(paths[0][1], np.int32)))
        offsets = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(offsets[-1], np.int32)
        for part, ids in parts:
            sizes = counts[part]
            begins = np.cumsum(sizes) - sizes
            flat[np.repeat(offsets[part] - begins, sizes) + np.arange(len(ids))] = ids
        return offsets, flat, score, loss

    def _vector_best(self, segments: list[str], length: int, own: np.ndarray):
        """Viterbi from both ends over segments of one length.

        Of equal scores the longest last piece is taken, as by ``_nbest``.
        ``own`` has the lengths of the pieces by merges, by segment and end.
        """
        rows = len(segments)
        cps = np.frombuffer("".join(segments).encode("utf-32-le", "replace"), np.uint32).reshape(rows, length)
        prefix = np.zeros((length + 1, rows), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * _PRIME + cps[:, j] + np.uint64(1)
        edges: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        forward = np.full((length + 1, rows), NONE)
        forward[0] = 0
        back, back_id = np.zeros((length + 1, rows), np.int8), np.zeros((length + 1, rows), np.int32)
        for j in range(1, length + 1):
            for n in range(min(j, self.longest), 0, -1):
                h = prefix[j] - prefix[j - n] * self.powers[n]
                there = np.flatnonzero(self.maybe[h >> np.uint64(44)])
                at = np.minimum(np.searchsorted(self.keys, h[there]), len(self.keys) - 1)
                hit = self.keys[at] == h[there]
                there, at = there[hit], at[hit]
                if n > 1 and not len(there):
                    continue
                value = np.full(rows, self.unknown if n == 1 else NONE)
                value[there] = self.piece_scores[at]
                value[own[:, j] == n] = 0
                edges[j, n] = value
                if n == 1:
                    total = forward[j - 1] + value
                    better = total > forward[j]
                    forward[j][better] = total[better]
                    back[j][better] = 1
                    back_id[j][better] = -1
                    took = better[there]
                    back_id[j][there[took]] = self.ids[at[took]]
                else:
                    total = forward[j - n][there] + value[there]
                    better = total > forward[j][there]
                    to = there[better]
                    forward[j][to] = total[better]
                    back[j][to] = n
                    back_id[j][to] = self.ids[at[better]]
        backward = np.full((length + 1, rows), NONE)
        backward[length] = 0
        for j in range(length, 0, -1):
            for n in range(1, min(j, self.longest) + 1):
                if (j, n) in edges:
                    np.maximum(backward[j - n], backward[j] + edges[j, n], out=backward[j - n])
        on_path = np.zeros((length + 1, rows), bool)
        every, at = np.arange(rows), np.full(rows, length)
        chosen = np.full((length, rows), -2, np.int32)
        for _ in range(length):
            live = at > 0
            if not live.any():
                break
            r, a = every[live], at[live]
            on_path[a, r] = True
            at[live] = a - back[a, r]
            chosen[at[live], r] = back_id[a, r]
        second = np.full(rows, 2 * NONE)
        for (j, n), value in edges.items():
            other = np.where(on_path[j] & (back[j] == n), 2 * NONE, forward[j - n] + value + backward[j])
            np.maximum(second, other, out=second)
        loss = np.where(second > NONE // 2, forward[length] - second, -NONE)
        flat = chosen.T
        if (flat == -1).any():
            ids, sizes = [], np.zeros(rows, np.int64)
            for r in range(rows):
                own: list[int] = []
                for k in np.flatnonzero(flat[r] != -2):
                    own += [int(flat[r][k])] if flat[r][k] >= 0 else [self.bytes[c] for c in segments[r][k].encode()]
                ids += own
                sizes[r] = len(own)
            return forward[length], loss, np.array(ids, np.int32), sizes
        there = flat != -2
        return forward[length], loss, flat[there], there.sum(axis=1)

    def segments(self, text: pa.Array) -> pa.Array:
        """Lists of segments of texts without nulls."""
        mark = next(m for m in map(chr, range(0xF0000, 0xFFFFD)) if not pc.any(pc.match_substring(text, m)).as_py())
        marked = pc.replace_substring(pc.replace_substring(text, " ", mark + SPACE), SPACE, SPACE)
        if self.prefix:
            marked = pc.if_else(pc.equal(text, ""), "", pc.binary_join_element_wise(SPACE, marked, ""))
        marked = pc.replace_substring(marked, "\n", mark + "\n" + mark)
        for _ in range(2):
            marked = pc.replace_substring(marked, SPACE + mark + SPACE, SPACE + SPACE)
        return pc.split_pattern(marked, mark)

    def encode(self, text: pa.Array, n: int) -> list[list[tuple[float, np.ndarray]]]:
        """For every text, up to ``n`` (score, ids), best first."""
        return [paths for _, group in self.encode_groups(text, n) for paths in group]

    def encode_groups(self, text: pa.Array, n: int) -> Iterator[tuple[int, list[list[tuple[float, np.ndarray]]]]]:
        """``encode`` in groups of rows: the first row and the group's paths."""
        lists = self.segments(text)
        flat = lists.flatten()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = flat.dictionary_encode()
        codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        starts, ids, score, loss = self.best(names)
        sizes = (starts[1:] - starts[:-1])[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat_ids = ids[np.repeat(starts[codes] - ends[:-1], sizes) + np.arange(ends[-1])]
        scores, losses = score[codes], loss[codes]
        out = []
        for row in range(len(text)):
            if len(out) == GROUP_ROWS:
                yield row - GROUP_ROWS, out
                out = []
            lo, hi = offsets[row], offsets[row + 1]
            own = flat_ids[ends[lo] : ends[hi]]
            total = int(scores[lo:hi].sum())
            paths: list[tuple[int, tuple]] = [(0, ())]
            if n > 1:
                near = losses[lo:hi]
                take = np.argsort(near, kind="stable")[: n - 1] if hi - lo <= 4 * n else self._least(near, n - 1)
                for k in np.sort(take[near[take] < -NONE]):
                    best = self.nbest(names[codes[lo + k]], n)
                    more = [(best[0][0] - s, i) for i, (s, _) in enumerate(best)]
                    paths = sorted(((a + b, p + (((int(k), i),) if i else ())) for a, p in paths for b, i in more), key=lambda x: (x[0], len(x[1]), x[1]))[:n]
            texts = []
            for lost, changes in paths:
                parts, done = [], 0
                for k, i in changes:
                    a, b = ends[lo + k] - ends[lo], ends[lo + k + 1] - ends[lo]
                    parts += [own[done:a], np.array(self.nbest(names[codes[lo + k]], n)[i][1], np.int32)]
                    done = b
                texts.append(((total - lost) / SCALE, np.concatenate([*parts, own[done:]]) if parts else own))
            out.append(texts)
        if out:
            yield len(text) - len(out), out

    @staticmethod
    def _least(values: np.ndarray, k: int) -> np.ndarray:
        """Places of the ``k`` least values, ties by place."""
        bound = np.partition(values, k - 1)[k - 1]
        sure, tied = np.flatnonzero(values < bound), np.flatnonzero(values == bound)
        return np.concatenate([sure, tied[: k - len(sure)]])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of id lists; bytes that aren't UTF-8 become U+FFFD."""
        taken = self.surface.take(pa.array(ids))
        at = np.frombuffer(taken.buffers()[1], np.int32)[: len(ids) + 1]
        data = taken.buffers()[2] or pa.py_buffer(b"")
        lo, hi = at[offsets[:-1]].astype(np.int64), at[offsets[1:]].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)
        if self.prefix and len(raw):
            lo = lo + ((hi > lo) & (raw[np.minimum(lo, len(raw) - 1)] == 32))
        view = memoryview(data)
        return pa.array([bytes(view[a:b]).decode("utf-8", "replace") for a, b in zip(lo, hi)], pa.string())


def _int_lists(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
    return np.concatenate(lists) if lists else np.empty(0, np.int32), offsets


def encode(docs: DataFrame, model_path: str, *, nbest: int = NBEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank, score, ids, round_trip): a row for each of the N best paths.

    ``rank`` 1 is the best; ``round_trip`` tells whether the ids decode to the
    text. A lattice with fewer paths gives fewer rows.

    With a BPE model rank 1 is what the library's own encoding gives.

    Defined cases: an empty text has one path, without ids and with score 0. A
    null text gives one row of rank 1 whose score, ids and round_trip are null.
    Equal scores have an order that depends on the text alone: first the path
    that leaves the best one in fewer segments, then in earlier ones; inside a
    segment the one with the longer last piece. Characters outside the vocabulary become bytes. The space
    mark U+2581 in a text is read as a space, as by the library, so it doesn't
    round-trip. Repeated rows give repeated results, null ids stay, whole texts
    count whatever their length. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "rank", "score", "ids", "round_trip"]

    def run(batches):
        lattice = Lattice(shared.value)
        for batch in batches:
            for start, text in chunks(batch.column(1), CHUNK_BYTES):
                known = pc.is_valid(text)
                for row, part in ((np.flatnonzero(known.to_numpy(zero_copy_only=False)), text.drop_null()), (np.flatnonzero(~known.to_numpy(zero_copy_only=False)), None)):
                    if not len(row):
                        continue
                    ids = batch.column(0).take(pa.array(row + start))
                    if part is None:
                        empty = [pa.nulls(len(row), t) for t in (pa.float64(), pa.list_(pa.int32()), pa.bool_())]
                        yield pa.RecordBatch.from_arrays([ids, pa.array(np.ones(len(row), np.int32)), *empty], names)
                        continue
                    for first, found in lattice.encode_groups(part, nbest):
                        counts = np.fromiter(map(len, found), np.int64, len(found))
                        owner = np.repeat(np.arange(len(found)), counts)
                        flat, offsets = _int_lists([ids for paths in found for _, ids in paths])
                        same = pc.equal(lattice.decode(flat, offsets), part.take(pa.array(owner + first)))
                        rank = np.concatenate([np.arange(1, c + 1) for c in counts]).astype(np.int32)
                        scored = pa.array([s for paths in found for s, _ in paths], pa.float64())
                        listed = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner + first)), pa.array(rank), scored, listed, same], names)

    schema = f"`{id_col}` {id_type}, rank int, score double, ids array<int>, round_trip boolean"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decoder(spark, model_path: str):
    """A column function from arrays of ids to texts; null gives null."""
    shared = spark.sparkContext.broadcast(read_model(model_path))

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        flat = pc.fill_null(ids.flatten(), 0).to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        texts = Lattice(shared.value).decode(flat, np.concatenate([[0], np.cumsum(sizes)]))
        return pc.if_else(pc.is_valid(ids), texts, pa.scalar(None, pa.string()))

    return decode
