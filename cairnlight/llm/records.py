"""Token ids as length-delimited binary records, with an offset index.

A record is the framing that TFRecord readers know: the payload's length (8
bytes, little endian), a masked CRC-32C of these, the payload, and its masked
CRC-32C. The payload is a sequence's token ids, 2 bytes each (4 for a larger
vocabulary). Each task writes one file, under a name of its attempt that is
moved to the final name when it is complete, so a task that runs again leaves
one whole file. The index is a Parquet table beside the files; with it any
order of sequences can be read by seeking.

Checksums are computed for a batch at once: payloads are cut into equal strips,
all strips advance together through slicing tables, and a table that skips a
strip of zeros joins them.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .words import chunks

STRIP = 256
CHUNK_BYTES = 8 << 20
MASK_DELTA = 0xA282EAD8
HEADER, FOOTER = 12, 4


def _tables() -> np.ndarray:
    t = np.zeros((8, 256), np.uint32)
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0x82F63B78), c >> 1)
    t[0] = c
    for k in range(1, 8):
        t[k] = t[0][t[k - 1] & 255] ^ (t[k - 1] >> 8)
    return t


def _skip(tables: np.ndarray, strip: int) -> np.ndarray:
    """Tables that advance a checksum over ``strip`` zero bytes."""
    c = (np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]).ravel()
    for _ in range(strip):
        c = tables[0][c & 255] ^ (c >> 8)
    return c.reshape(4, 256)


TABLES = _tables()
SKIP = _skip(TABLES, STRIP)


def _advance(crc: np.ndarray, words: np.ndarray) -> np.ndarray:
    """``crc`` through rows of little-endian 32-bit words, two at a time."""
    t = TABLES
    for k in range(0, words.shape[1], 2):
        lo, hi = crc ^ words[:, k], words[:, k + 1]
        crc = t[7][lo & 255] ^ t[6][(lo >> 8) & 255] ^ t[5][(lo >> 16) & 255] ^ t[4][lo >> 24] ^ t[3][hi & 255] ^ t[2][(hi >> 8) & 255] ^ t[1][(hi >> 16) & 255] ^ t[0][hi >> 24]
    return crc


def crc32c(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CRC-32C of each stretch of bytes between neighbouring offsets."""
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), np.uint32)
    for row in np.flatnonzero(sizes < 4):
        c = 0xFFFFFFFF
        for b in data[offsets[row] : offsets[row + 1]]:
            c = int(TABLES[0][(c ^ int(b)) & 255]) ^ (c >> 8)
        out[row] = c ^ 0xFFFFFFFF
    rows = np.flatnonzero(sizes >= 4)
    if not len(rows):
        return out
    size, start = sizes[rows], offsets[:-1][rows]
    strips = -(-size // STRIP)
    ends = np.cumsum(strips)
    begins = ends * STRIP - size  # zeros in front don't change a checksum from 0
    padded = np.zeros(ends[-1] * STRIP, np.uint8)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    padded[np.repeat(begins, size) + within] = data[np.repeat(start, size) + within]
    for k in range(4):
        padded[begins + k] ^= 0xFF
    each = _advance(np.zeros(ends[-1], np.uint32), padded.view("<u4").reshape(-1, STRIP // 4))
    first = ends - strips
    crc = each[first]
    live = np.flatnonzero(strips > 1)
    k = 1
    while len(live):
        c = crc[live]
        crc[live] = SKIP[0][c & 255] ^ SKIP[1][(c >> 8) & 255] ^ SKIP[2][(c >> 16) & 255] ^ SKIP[3][c >> 24] ^ each[first[live] + k]
        k += 1
        live = live[strips[live] > k]
    out[rows] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frame(payload: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The records of a batch as one string, their offsets, the payload checksums."""
    sizes = np.diff(offsets)
    count = len(sizes)
    lengths = sizes.astype("<u8").view(np.uint8).reshape(count, 8)
    head = masked(crc32c(lengths.ravel(), np.arange(count + 1) * 8))
    body = masked(crc32c(payload, offsets))
    ends = np.cumsum(sizes + HEADER + FOOTER)
    starts = ends - sizes - HEADER - FOOTER
    out = np.empty(ends[-1] if count else 0, np.uint8)
    out[starts[:, None] + np.arange(8)] = lengths
    out[starts[:, None] + 8 + np.arange(4)] = head.astype("<u4").view(np.uint8).reshape(count, 4)
    out[(ends - 4)[:, None] + np.arange(4)] = body.astype("<u4").view(np.uint8).reshape(count, 4)
    within = np.arange(len(payload)) - np.repeat(offsets[:-1], sizes)
    out[np.repeat(starts + HEADER, sizes) + within] = payload
    return out.tobytes(), starts, body


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: White space that isn't one space or one line break between other characters.
IRREGULAR = r"[^\S \n]|  | \n|\n |\n\n|^\s|\s$|^$"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer:
    """Byte-level BPE ids of batches; each distinct word is encoded once."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.coder = tiktoken.Encoding("records", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.line_break = ranks[b"\n"]

    def _many(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of strings; plain words go through the coder as lines."""
        plain = pc.match_substring_regex(names, r"^ ?\S+$").to_numpy(zero_copy_only=False)
        counts, parts = np.zeros(len(names), np.int64), []
        rows = np.flatnonzero(plain)
        if len(rows):
            ids = np.array(self.coder.encode_ordinary("\n".join(names.filter(pa.array(plain)).to_pylist())), np.int32)
            ends = np.append(np.flatnonzero(ids == self.line_break), len(ids))
            counts[rows] = np.diff(ends, prepend=-1) - 1
            parts.append((rows, ids[ids != self.line_break]))
        for row in np.flatnonzero(~plain):
            ids = np.array(self.coder.encode_ordinary(names[row].as_py()), np.int32)
            counts[row] = len(ids)
            parts.append((np.array([row]), ids))
        offsets = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(offsets[-1], np.int32)
        for row, ids in parts:
            begins = np.cumsum(counts[row]) - counts[row]
            flat[np.repeat(offsets[row] - begins, counts[row]) + np.arange(len(ids))] = ids
        return flat, offsets

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets for texts without nulls."""
        mark = next(m for m in map(chr, range(0xF0000, 0xFFFFD)) if not pc.any(pc.match_substring(text, m)).as_py())
        odd = pc.match_substring_regex(text, IRREGULAR)
        marked = pc.replace_substring(pc.replace_substring(text, " ", mark + " "), "\n", mark + "\n" + mark)
        marked = pc.if_else(odd, text, marked)
        lists = pc.split_pattern(marked, mark)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ids, starts = self._many(coded.dictionary)
        sizes = np.diff(starts)[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = ids[np.repeat(starts[codes] - ends[:-1], sizes) + np.arange(ends[-1])]
        return flat, ends[offsets - offsets[0]]


def write_records(docs: DataFrame, path: str, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``path``/part-*.rec and ``path``/index; the index is returned.

    Its rows are (id, file, offset, length, n_tokens, crc): where a record
    begins in which file, its payload's bytes, and the masked checksum. A file
    is named by its partition and task attempt, and the index holds rows of
    committed attempts only, so a retried or lost task leaves no wrong offsets.
    Files of tasks without rows, and of lost attempts, are deleted at the end.

    Defined cases: a null text has no record and no index row. An empty text
    has a record without payload. Repeated rows and null ids have records like
    any others. A sequence is one record whatever its length. Other columns are
    not looked at. An empty table gives an empty index.
    """
    spark = docs.sparkSession
    ranks = read_ranks(ranks_path)
    kind = "<u2" if max(ranks.values()) < 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(ranks)
    names = [id_col, "file", "offset", "length", "n_tokens", "crc"]

    def run(batches):
        tokenizer, task = Tokenizer(shared.value), TaskContext.get()
        files, root = fs.FileSystem.from_uri(path)
        files.create_dir(root, recursive=True)
        # an attempt's own name: no other attempt can put other bytes under it
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.rec"
        draft = f"{root}/.{name}"
        at = 0
        with files.open_output_stream(draft) as sink:
            for batch in batches:
                for start, text in chunks(batch.column(1), CHUNK_BYTES):
                    row = np.flatnonzero(pc.is_valid(text).to_numpy(zero_copy_only=False))
                    if not len(row):
                        continue
                    ids, offsets = tokenizer.encode(text.drop_null())
                    payload = ids.astype(kind).view(np.uint8)
                    width = np.dtype(kind).itemsize
                    data, starts, crc = frame(payload, offsets * width)
                    sink.write(data)
                    tokens = np.diff(offsets)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row + start)), pa.array([name] * len(row)), pa.array(starts + at), pa.array(tokens * width), pa.array(tokens.astype(np.int32)), pa.array(crc.astype(np.int64))], names
                    )
                    at += len(data)
        files.move(draft, f"{root}/{name}")

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, file string, offset long, length long, n_tokens int, crc long")
    rows.write.parquet(f"{path}/index")
    index = spark.read.schema(rows.schema).parquet(f"{path}/index")
    drop_orphans(index, path)
    return index


def drop_orphans(index: DataFrame, path: str) -> list[str]:
    """Delete record files and drafts that no index row names, left by lost attempts."""
    files, root = fs.FileSystem.from_uri(path)
    known = {r[0] for r in index.select("file").distinct().collect()}
    found = [f for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.endswith(".rec") and f.base_name not in known]
    for f in found:
        files.delete_file(f.path)
    return sorted(f.base_name for f in found)


def read_records(index: DataFrame, path: str, width: int = 2) -> DataFrame:
    """``index`` with ``ids``, read in the order of its rows; checksums must hold."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)

    def run(batches):
        files, root = fs.FileSystem.from_uri(path)
        held: dict = {}
        for batch in batches:
            ids = []
            for name, offset, length in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "offset", "length"))):
                if name not in held:
                    held[name] = files.open_input_file(f"{root}/{name}")
                raw = np.frombuffer(held[name].read_at(HEADER + length + FOOTER, offset), np.uint8)
                ends = np.array([0, 8]), np.array([HEADER, HEADER + length])
                sums = [int(masked(crc32c(raw, e))[0]) for e in ends]
                stored = [int(raw[k : k + 4].view("<u4")[0]) for k in (8, HEADER + length)]
                if int(raw[:8].view("<u8")[0]) != length or sums != stored:
                    raise ValueError(f"record at {offset} in {name} is damaged")
                ids.append(raw[HEADER : HEADER + length].view(f"<u{width}").astype(np.int32))
            lists = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "ids"])

    return index.mapInArrow(run, f"{columns}, ids array<int>")
