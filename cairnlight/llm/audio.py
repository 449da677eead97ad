"""Telephony audio columns: G.711 and IMA ADPCM to resampled 16-bit PCM.

Mu-law and A-law bytes expand through tables of 256 samples. ADPCM blocks carry
their own start state, so numpy decodes all blocks of a batch side by side: one
step for each sample of a block, over as many lanes as there are blocks.
Resampling is a polyphase windowed-sinc filter with integer taps, so results
don't depend on the order of sums. Each row is filtered by itself.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import fresh
from .words import chunks

BLOCK_BYTES = 256
TAPS = 16
SCALE_BITS = 14
OUT_BYTES = 4 << 20

INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int64)
STEP = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int64,
)


def mulaw_table() -> np.ndarray:
    b = ~np.arange(256) & 255
    t = (((b & 15) << 3) + 0x84) << ((b & 0x70) >> 4)
    return np.where(b & 0x80, 0x84 - t, t - 0x84).astype(np.int16)


def alaw_table() -> np.ndarray:
    b = np.arange(256) ^ 0x55
    t, seg = (b & 15) << 4, (b & 0x70) >> 4
    t = np.where(seg == 0, t + 8, (t + 0x108) << np.maximum(seg - 1, 0))
    return np.where(b & 0x80, t, -t).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def _adpcm_steps() -> tuple[np.ndarray, np.ndarray]:
    """For each (step index, nibble): the change of the sample, the next index."""
    n = np.arange(16)
    s = STEP[:, None]
    diff = (s >> 3) + np.where(n & 4, s, 0) + np.where(n & 2, s >> 1, 0) + np.where(n & 1, s >> 2, 0)
    return np.where(n & 8, -diff, diff).astype(np.int32).ravel(), np.clip(np.arange(89)[:, None] + INDEX_STEP, 0, 88).astype(np.int32).ravel()


ADPCM_DIFF, ADPCM_NEXT = _adpcm_steps()


def adpcm_samples(sizes: np.ndarray, block: int) -> np.ndarray:
    """Samples in streams of so many bytes; a tail without a whole header has none."""
    tail = sizes % block
    return sizes // block * ((block - 4) * 2 + 1) + np.where(tail >= 4, (tail - 4) * 2 + 1, 0)


def decode_adpcm(data: np.ndarray, offsets: np.ndarray, block: int = BLOCK_BYTES) -> np.ndarray:
    """Samples of all streams, one after the other."""
    sizes = np.diff(offsets)
    blocks = -(-sizes // block)
    owner = np.repeat(np.arange(len(sizes)), blocks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = offsets[:-1][owner] + number * block
    length = np.minimum(sizes[owner] - number * block, block)
    keep = length >= 4
    start, length = start[keep], length[keep]
    counts = (length - 4) * 2 + 1
    if not len(start):
        return np.empty(0, np.int16)
    by = np.argsort(-length, kind="stable")
    start, length = start[by], length[by]
    most = int(length[0])
    padded = np.concatenate([data, np.zeros(block, np.uint8)])
    out = np.zeros(((most - 4) * 2 + 1, len(start)), np.int16)
    value = (padded[start].astype(np.uint16) | (padded[start + 1].astype(np.uint16) << np.uint16(8))).view(np.int16).astype(np.int32)
    index = np.minimum(padded[start + 2], 88).astype(np.int32)
    out[0] = value
    lanes = np.searchsorted(-length, -np.arange(most + 1), side="right")
    for k in range(4, most):
        live = lanes[k + 1]
        byte = padded[start[:live] + k]
        for half, nibble in enumerate((byte & 15, byte >> 4)):
            at = index[:live] * 16 + nibble
            value[:live] = np.clip(value[:live] + ADPCM_DIFF[at], -32768, 32767)
            index[:live] = ADPCM_NEXT[at]
            out[(k - 4) * 2 + 1 + half, :live] = value[:live]
    back = np.empty(len(by), np.int64)
    back[by] = np.arange(len(by))
    ends = np.cumsum(counts)
    within = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
    return out.T.ravel()[np.repeat(back * out.shape[0], counts) + within]


def filter_taps(up: int, down: int) -> np.ndarray:
    """Integer taps, shape (up, TAPS): a Hann-windowed sinc for each phase."""
    cut = min(1.0, up / down)
    x = (TAPS // 2 - 1 - np.arange(TAPS))[None, :] + np.arange(up)[:, None] / up
    h = np.sinc(x * cut) * cut * np.cos(np.pi * x / TAPS) ** 2
    return np.rint(h / h.sum(axis=1, keepdims=True) * (1 << SCALE_BITS)).astype(np.int64)


def resampled_length(n: np.ndarray, up: int, down: int) -> np.ndarray:
    return -(-n * up // down)


def resample(samples: np.ndarray, counts: np.ndarray, rate_in: int, rate_out: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples at the new rate and their counts; silence lies around each row."""
    common = math.gcd(rate_in, rate_out)
    up, down = rate_out // common, rate_in // common
    out_counts = resampled_length(counts, up, down)
    if up == down:
        return samples, counts
    taps = filter_taps(up, down)
    half = TAPS // 2
    starts = np.cumsum(counts + TAPS) - counts - TAPS + half
    spaced = np.zeros(int((counts + TAPS).sum()), np.float64)
    spaced[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(samples))] = samples
    within = np.arange(int(out_counts.sum())) - np.repeat(np.cumsum(out_counts) - out_counts, out_counts)
    source = np.repeat(starts, out_counts) + within * down // up
    phase = within * down % up
    if up <= 8:
        # y[p, n] = sum over k of taps[p, k] * x[n + k - half + 1]
        whole = np.stack([spaced if not taps[p, : half - 1].any() and not taps[p, half:].any() else np.convolve(spaced, taps[p, ::-1].astype(np.float64))[half : half + len(spaced)] / (1 << SCALE_BITS) for p in range(up)])
        y = whole[phase, source]
    else:
        y = sum(taps[phase, k] * spaced[source + (k - half + 1)] for k in range(TAPS)) / (1 << SCALE_BITS)
    return np.clip(np.floor(y + 0.5), -32768, 32767).astype(np.int16), out_counts


def decode_batch(payload: pa.Array, codec: str, rate_in: int, rate_out: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """PCM of payloads of one codec, without nulls: samples and their counts."""
    sizes = pc.binary_length(payload).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    first = np.frombuffer(payload.buffers()[1], np.int32)[payload.offset]
    data = np.frombuffer(payload.buffers()[2] or b"", np.uint8)[first : first + offsets[-1]]
    if codec == "ima_adpcm":
        samples, counts = decode_adpcm(data, offsets, block), adpcm_samples(sizes, block)
    else:
        samples, counts = TABLES[codec][data], sizes
    return resample(samples, counts, rate_in, rate_out)


def to_pcm(media: DataFrame, *, id_col: str = "id", payload_col: str = "payload", codec_col: str = "codec", rate_in: int = 8000, rate_out: int = 16000, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, codec, sample_rate, n_samples, pcm): little-endian 16-bit mono.

    Codecs are mulaw, alaw and ima_adpcm (mono WAV blocks of ``block_bytes``: a
    start sample, a step index, a zero byte, then nibbles, the low one first).

    Defined cases: a null payload, a null codec and one of another name give
    null n_samples and pcm. An empty payload gives no samples. A last block may
    be short; without a whole header it holds nothing. A step index above 88
    counts as 88. Repeated rows and null ids stay. Payloads of any length are
    decoded whole. Other columns are not looked at.
    """
    id_type = media.schema[id_col].dataType.simpleString()
    n_col, pcm_col, rate_col = "n_samples", "pcm", "sample_rate"
    names = [id_col, codec_col, rate_col, n_col, pcm_col]
    known = [*TABLES, "ima_adpcm"]

    def run(batches):
        for batch in batches:
            ids, codecs = batch.column(0), batch.column(2)
            for start, part in chunks(batch.column(1), OUT_BYTES // 4):
                own = codecs.slice(start, len(part))
                good = pc.and_(pc.is_valid(part), pc.fill_null(pc.is_in(own, pa.array(known)), False))
                groups = [(None, np.flatnonzero(~good.to_numpy(zero_copy_only=False)))]
                groups += [(c, np.flatnonzero(pc.fill_null(pc.and_(good, pc.equal(own, c)), False).to_numpy(zero_copy_only=False))) for c in known]
                for codec, row in groups:
                    if not len(row):
                        continue
                    where = pa.array(row + start)
                    head = [ids.take(where), codecs.take(where), pa.array(np.full(len(row), rate_out, np.int32))]
                    if codec is None:
                        body = [pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.binary())]
                    else:
                        samples, counts = decode_batch(part.take(pa.array(row)), codec, rate_in, rate_out, block_bytes)
                        ends = np.concatenate([[0], np.cumsum(counts * 2)]).astype(np.int32)
                        pcm = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(samples.astype("<i2"))])
                        body = [pa.array(counts), pcm]
                    yield pa.RecordBatch.from_arrays(head + body, names)

    schema = f"`{id_col}` {id_type}, `{codec_col}` string, {rate_col} int, {n_col} long, {pcm_col} binary"
    return media.select(id_col, payload_col, codec_col).mapInArrow(run, schema)


def media_of(docs: DataFrame) -> DataFrame:
    """Media rows of documents: their UTF-8 bytes as a call's payload."""
    payload, codec = fresh(docs, "payload", "codec")
    named = F.when(F.col("lang") == "en", "mulaw").when(F.col("lang") == "fr", "alaw").otherwise("ima_adpcm")
    return docs.select("doc_id", F.encode("text", "UTF-8").alias(payload), named.alias(codec))
