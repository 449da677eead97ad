import math

import numpy as np
import pytest

from cairnlight.llm import audio


def adpcm(data, block):
    out = []
    for s in range(0, len(data), block):
        part = data[s : s + block]
        if len(part) < 4:
            continue
        value, index = int.from_bytes(part[:2], "little", signed=True), min(part[2], 88)
        out.append(value)
        for byte in part[4:]:
            for n in (byte & 15, byte >> 4):
                step = int(audio.STEP[index])
                diff = (step >> 3) + (step if n & 4 else 0) + (step >> 1 if n & 2 else 0) + (step >> 2 if n & 1 else 0)
                value = max(-32768, min(32767, value - diff if n & 8 else value + diff))
                index = max(0, min(88, index + int(audio.INDEX_STEP[n])))
                out.append(value)
    return out


def resampled(x, a, b):
    g = math.gcd(a, b)
    up, down = b // g, a // g
    if up == down:
        return list(x)
    taps, half, out = audio.filter_taps(up, down), audio.TAPS // 2, []
    for m in range(-(-len(x) * up // down)):
        c, p = m * down // up, m * down % up
        total = sum(int(taps[p, k]) * x[c + k - half + 1] for k in range(audio.TAPS) if 0 <= c + k - half + 1 < len(x))
        out.append(max(-32768, min(32767, (total + (1 << 13)) >> 14)))
    return out


def payloads():
    rng = np.random.default_rng(1)
    return [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 3, 4, 5, 255, 256, 257, 260, 700)]


def test_tables():
    mu, a = audio.TABLES["mulaw"], audio.TABLES["alaw"]
    assert (mu[0xFF], mu[0x7F], mu[0x00], mu[0x80]) == (0, 0, -32124, 32124)
    assert (a[0xD5], a[0x55], a[0x2A], a[0xAA]) == (8, -8, -32256, 32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def test_blocks_side_by_side():
    data = payloads()
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in data])])
    flat = np.frombuffer(b"".join(data), np.uint8)
    assert audio.decode_adpcm(flat, offsets).tolist() == [x for p in data for x in adpcm(p, 256)]
    assert audio.adpcm_samples(np.diff(offsets), 256).tolist() == [len(adpcm(p, 256)) for p in data]


@pytest.mark.parametrize("rates", [(8000, 16000), (8000, 24000), (8000, 11025), (16000, 8000), (8000, 8000), (8000, 12000)])
def test_resampling(rates):
    rng = np.random.default_rng(2)
    rows = [rng.integers(-32768, 32768, n) for n in (0, 1, 5, 90)]
    got, counts = audio.resample(np.concatenate(rows).astype(np.int16), np.array([len(r) for r in rows]), *rates)
    want = [resampled([int(v) for v in r], *rates) for r in rows]
    assert got.tolist() == [v for w in want for v in w] and counts.tolist() == [len(w) for w in want]


def test_a_tone_keeps_its_pitch():
    x = np.rint(8000 * np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)).astype(np.int16)
    y, _ = audio.resample(x, np.array([8000]), 8000, 16000)
    want = 8000 * np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    assert np.abs(y[100:-100] - want[100:-100]).max() < 40


def test_column_and_odd_rows(spark):
    rows = [(k, p, c) for k, p in enumerate(payloads()) for c in ("mulaw", "alaw", "ima_adpcm")]
    rows += [(50, None, "mulaw"), (51, b"ab", None), (52, b"ab", "opus"), (None, b"ab", "mulaw"), (53, b"x" * 300_000, "alaw"), (1, rows[3][1], "mulaw")]
    media = spark.createDataFrame(rows, "id long, payload binary, codec string").selectExpr("*", "'x' AS pcm", "1 AS n_samples")
    got = {(r["id"], r["codec"]): r for r in audio.to_pcm(media).collect()}
    for i, p, c in rows:
        r = got[i, c]
        if p is None or c not in ("mulaw", "alaw", "ima_adpcm"):
            assert r["pcm"] is None and r["n_samples"] is None
            continue
        x = adpcm(p, 256) if c == "ima_adpcm" else [int(audio.TABLES[c][b]) for b in p]
        want = resampled(x, 8000, 16000) if len(x) < 2000 else None
        assert r["n_samples"] == 2 * len(x) and len(r["pcm"]) == 4 * len(x)
        assert want is None or np.frombuffer(r["pcm"], "<i2").tolist() == want
    assert audio.to_pcm(media.limit(0)).count() == 0
