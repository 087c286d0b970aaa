"""Removal of word passages that occur more than once, by difference-cover anchors.

A window is ``window`` consecutive words. Shorter windows of ``window - period + 1`` words
are hashed, but only where the word position modulo ``period`` lies in a difference cover:
for any two positions i and j there is a shift d < period with both i + d and j + d in the
cover, so any two equal windows share an equal anchor at the same place inside them.
Windows around a repeated anchor are then extended to full length and compared by a
128-bit hash.

Texts are packed once into blocks of about a MB, stored in the shared folder. A block
sends each distinct hash once, in an order it can derive again, and gets one bit back for
each. A passage that a third of all documents hold therefore costs one hash per block,
and no occurrence list of it exists anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.llm.common import bounded_batches, tidy
from textlab.sources.storage import materialize

WINDOW = 35
# A perfect difference set modulo 21; every residue is a difference of two.
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
BLOCK_BYTES = 1 << 20
# Hashes of one part are sorted in one task: about this many bytes of them.
PART_BYTES = 4 << 20
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 9, 10, 11, 12, 13]] = True


# -- blocks -----------------------------------------------------------------

def _compress(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(
            compression=pa.Codec("zstd", 3))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _expand(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def pack(df: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Stored blocks ``block, n_bytes, payload``: rows of ``df`` in compressed Arrow form,
    cut whenever their texts reach ``block_bytes`` (a longer text is a block of its own)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch[text]).fill_null(0).to_numpy()
            ends = np.cumsum(sizes.astype(np.int64))
            at = 0
            while at < batch.num_rows:
                base = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + block_bytes, "right")))
                size = int(ends[to - 1] - base)
                yield pa.RecordBatch.from_pydict(
                    {"n_bytes": [size], "payload": [_compress(batch.slice(at, to - at))]})
                at = to

    blocks = df.mapInArrow(tidy(run), "n_bytes long, payload binary")
    return materialize(
        blocks.select(F.monotonically_increasing_id().alias("block"), "*"), "substring_blocks")


class Words:
    """The words of the texts of one block, and hashes of runs of them.

    All texts are laid out as bytes with one space before each word, so a run of words is
    a slice, and its polynomial hash comes from a running sum.
    """

    def __init__(self, texts: pa.ChunkedArray):
        raw = [(t or "").encode() for t in texts.to_pylist()]
        data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
        space = _SPACES[data]
        # Keep word bytes and the space right before each word.
        first = np.zeros(len(data), bool)
        first[:-1] = space[:-1] & ~space[1:]
        keep = first | ~space
        self.bytes = np.where(space, np.uint8(32), data)[keep]
        starts = np.flatnonzero(self.bytes == 32)
        self.starts = np.append(starts, len(self.bytes))
        # Word index at which each text begins.
        sizes = np.array([len(r) + 1 for r in raw], np.int64)
        begin = np.concatenate(([0], np.cumsum(sizes)))
        before = np.concatenate(([0], np.cumsum(first)))
        self.first = before[np.minimum(begin, len(first))]
        self.n = len(starts)
        self.begin = np.repeat(self.first[:-1], np.diff(self.first))
        self.end = np.repeat(self.first[1:], np.diff(self.first))

    def hashes(self, at: np.ndarray, size: int, seed: int) -> np.ndarray:
        """64-bit hash of the ``size`` words from each word index in ``at``."""
        base, table = _base(seed)
        power, inverse = _powers(base, len(self.bytes))
        total = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum(table[self.bytes] * power, out=total[1:])
        s, e = self.starts[at], self.starts[at + size]
        return _mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))


def _base(seed: int) -> tuple[int, np.ndarray]:
    rng = np.random.default_rng(seed)
    table = rng.integers(0, 2**64, 256, np.uint64)
    return int(rng.integers(0, 2**64, dtype=np.uint64)) | 1, table


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0][:n], out[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def anchors(words: Words, window: int, period: int, cover: tuple[int, ...]):
    """Word index and hash of every anchor of a block."""
    size = window - period + 1
    at = np.arange(words.n)
    ok = np.isin((at - words.begin) % period, cover) & (at + size <= words.end)
    at = at[ok]
    return at, words.hashes(at, size, 1)


def windows_around(words: Words, found: np.ndarray, window: int, period: int) -> np.ndarray:
    """Starts of the windows in which a repeated anchor lies fewer than ``period`` words
    from the start."""
    mark = np.zeros(words.n + 1, np.int64)
    np.add.at(mark, np.maximum(found - period + 1, words.begin[found]), 1)
    np.add.at(mark, found + 1, -1)
    at = np.flatnonzero(np.cumsum(mark)[:-1])
    return at[at + window <= words.end[at]]


def window_keys(words: Words, at: np.ndarray, window: int) -> np.ndarray:
    """128-bit hashes of the bytes of full windows as 16-byte strings. Unlike the running
    sums of the anchors, which only propose, these decide."""
    text, digest = memoryview(words.bytes), xxhash.xxh3_128_digest
    spans = zip(words.starts[at].tolist(), words.starts[at + window].tolist())
    return np.frombuffer(b"".join([digest(text[a:b]) for a, b in spans]), "V16")


# -- one bit for each distinct hash of a block ------------------------------

def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    lead = keys.view("<u8")[:: keys.dtype.itemsize // 8]
    return (lead % np.uint64(parts)).astype(np.int64)


def _split(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Distinct keys by part, in a fixed order."""
    part = _part(keys, parts)
    order = np.argsort(part, kind="stable")
    bounds = np.flatnonzero(np.diff(part[order], prepend=-1, append=parts))
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield int(part[order[a]]), keys[order[a:b]]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, where each key is among them, and how often it occurs."""
    if keys.dtype.kind != "V":
        return np.unique(keys, return_inverse=True, return_counts=True)
    both = keys.view("<u8").reshape(-1, 2)
    order = np.lexsort((both[:, 1], both[:, 0]))
    new = np.ones(len(keys), bool)
    new[1:] = (both[order][1:] != both[order][:-1]).any(axis=1)
    rank = np.cumsum(new) - 1
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = rank
    return keys[order[new]], inverse, np.bincount(rank, minlength=int(new.sum()))


def _send(block: int, keys: np.ndarray, parts: int) -> list[dict]:
    distinct = _distinct(keys)[0]
    return [{"part": p, "block": block, "keys": k.tobytes()} for p, k in _split(distinct, parts)]


def _repeated(keys: np.ndarray, parts: int, reply: list) -> np.ndarray:
    """Which of a block's keys occur again, in the block itself or by the reply."""
    distinct, inverse, counts = _distinct(keys)
    again = {r["part"]: r["bits"] for r in reply or []}
    flags = []
    for p, k in _split(distinct, parts):
        bits = np.frombuffer(again[p], np.uint8) if p in again else np.zeros((len(k) + 7) // 8, np.uint8)
        flags.append(np.unpackbits(bits, count=len(k)).astype(bool))
    order = np.argsort(_part(distinct, parts), kind="stable")
    seen = np.zeros(len(distinct), bool)
    if flags:
        seen[order] = np.concatenate(flags)
    return (seen | (counts > 1))[inverse]


SENT = "part long, block long, keys binary"


def _replies(sent: DataFrame, width: int) -> DataFrame:
    """``block, reply``: for every key of a block a bit that says if another block has it."""
    def judge(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(k, f"V{width}" if width > 8 else "<u8")
                for k in table["keys"].to_pylist()]
        every = np.concatenate(rows)
        _, inverse, counts = _distinct(every)
        again, out, at = counts[inverse] > 1, [], 0
        for r in rows:
            out.append(np.packbits(again[at : at + len(r)]).tobytes())
            at += len(r)
        return pa.table({"part": table["part"], "block": table["block"],
                         "bits": pa.array(out, pa.binary())})

    bits = sent.groupBy("part").applyInArrow(judge, "part long, block long, bits binary")
    return bits.groupBy("block").agg(
        F.collect_list(F.struct("part", "bits")).alias("reply"))


# -- the operator -----------------------------------------------------------

def remove_repeats(
    docs: DataFrame, text: str = "text", window: int = WINDOW, period: int = PERIOD,
    cover: tuple[int, ...] = COVER, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` (longs), ``kept_sha256`` and ``kept``: the
    words that no repeated window covers, joined by one space.

    A window counts as repeated if its word sequence also starts anywhere else, in the
    same text or another; windows are judged on the input. A null text has no words and
    stays null in ``text``; its ``kept`` is empty. Repeated rows are repeats of each other
    and are all cut. Every input row gives one output row; columns with the names of the
    new ones are replaced.
    """
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("the cover misses a difference")
    if window < period:
        raise ValueError("a window needs at least as many words as the period")
    docs = docs.drop("n_words", "n_removed", "kept_sha256", "kept")
    schema, spark = docs.schema, docs.sparkSession
    bounded_batches(spark)
    blocks = pack(docs, text, block_bytes)
    size = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    # About one word in six bytes, and a share of the cover of them is hashed.
    parts = max(_parallel(spark), size * len(cover) // period * 8 // 6 // PART_BYTES)
    parts2 = max(_parallel(spark), size * 16 // 6 // 4 // PART_BYTES)

    def send_anchors(batches):
        for batch in batches:
            for block, payload in zip(batch["block"].to_pylist(), batch["payload"].to_pylist()):
                words = Words(_expand(payload)[text])
                _, keys = anchors(words, window, period, cover)
                if rows := _send(block, keys, parts):
                    yield pa.RecordBatch.from_pylist(rows)

    def candidates(payload, reply):
        table = _expand(payload)
        words = Words(table[text])
        at, keys = anchors(words, window, period, cover)
        found = at[_repeated(keys, parts, reply)]
        at = windows_around(words, found, window, period)
        return table, words, at, window_keys(words, at, window)

    def send_windows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, _, _, keys = candidates(row["payload"], row["reply"])
                if rows := _send(row["block"], keys, parts2):
                    yield pa.RecordBatch.from_pylist(rows)

    def cut(batches):
        for batch in batches:
            for row in batch.to_pylist():
                table, words, at, keys = candidates(row["payload"], row["reply"])
                starts = at[_repeated(keys, parts2, row["second"])]
                yield from _cut(table, words, starts, window).to_batches()

    # Replies hold a bit per hash; payloads are read again rather than stored again.
    first = materialize(_replies(blocks.mapInArrow(tidy(send_anchors), SENT), 8), "substring_anchors")
    marked = blocks.select("block", "payload").join(first, "block", "left")
    second = _replies(marked.mapInArrow(tidy(send_windows), SENT), 16)
    second = materialize(second.withColumnRenamed("reply", "second"), "substring_windows")
    ready = marked.join(second, "block", "left")
    fields = "n_words long, n_removed long, kept_sha256 string, kept string"
    out = spark.createDataFrame([], fields).schema
    return ready.mapInArrow(tidy(cut), type(schema)(schema.fields + out.fields))


def _parallel(spark: SparkSession) -> int:
    return max(16, spark.sparkContext.defaultParallelism * 2)


def _cut(table: pa.Table, words: Words, starts: np.ndarray, window: int) -> pa.Table:
    mark = np.zeros(words.n + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + window, -1)
    gone = np.cumsum(mark)[:-1] > 0
    per_byte = np.repeat(~gone, np.diff(words.starts))
    left = words.bytes[per_byte].tobytes()
    sizes = np.concatenate(([0], np.cumsum(np.where(gone, 0, np.diff(words.starts)))))
    spans = sizes[words.first]
    removed = np.concatenate(([0], np.cumsum(gone)))[words.first]
    # Each word carries the space before it; the first of a text loses it.
    kept = [left[a + 1 : b] for a, b in zip(spans[:-1].tolist(), spans[1:].tolist())]
    columns = {
        "n_words": pa.array(np.diff(words.first), pa.int64()),
        "n_removed": pa.array(np.diff(removed), pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        "kept": pa.array([k.decode() for k in kept], pa.string()),
    }
    for name, column in columns.items():
        table = table.append_column(name, column)
    return table


def without_repeats(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated passages cut from the text. A text that loses nothing
    stays as it is, white space included; ``n_chars`` follows the text if there is one."""
    out = remove_repeats(docs, text, **options)
    new = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(text))
    out = out.withColumn(text, new)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(
            F.col("n_removed") > 0, F.length(text).cast(kind)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
