"""Byte-level BPE from a rank file by overlapping chunks.

A long text is cut into chunks that overlap their successors. Every chunk is split into
pre-tokens on its own, from its first character on, wherever that lies. What the splitter
does from a boundary on depends only on the text behind it, so as soon as two neighbours
have a boundary in common inside their overlap, they agree from there: that place is the
stitch, up to which the first chunk's pre-tokens count and from which the second one's do.
A chunk that never meets its successor (a pre-token longer than the overlap) is fused with
it and split again. The pre-tokens between two stitches are then merged by rank: the
different ones of a piece by the tiktoken library, in one call. Texts of one chunk need no stitch and are encoded where they are read.

Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.common import bounded_batches
from textlab.sources.storage import materialize

# Characters of a chunk and of its overlap with the next one.
STRIDE = 65_536
OVERLAP = 512
# How far behind its end a pre-token may depend on the text: the ending of an apostrophe.
_LOOKAHEAD = 2
# Words remembered by a task, of at most so many bytes each.
_MEMO_WORDS, _MEMO_BYTES = 200_000, 64
_TOGETHER = 1 << 20
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
# The endings that belong to an apostrophe in front of them.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

NEW = [T.StructField("n_tokens", T.LongType()),
       T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
       T.StructField("decoded", T.BinaryType())]


# -- pre-tokens -------------------------------------------------------------

@lru_cache(1)
def character_kinds() -> bytes:
    """Kind of every code point as the library's own pattern engine sees it, one byte each:
    versions of Unicode differ between libraries."""
    single = {bytes([b]): b for b in range(256)}
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        probe = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=single, special_tokens={})
        matched = bytes(probe.encode_ordinary("".join(map(chr, points)))).decode()
        out[np.frombuffer(matched.encode("utf-32-le"), np.uint32)] = kind
    return out.tobytes()


def begins_of_words(codes: np.ndarray, breaks: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point; a text begins at each of ``breaks``
    (the last one is the end).

    A pre-token is a run of letters, of numbers or of other characters, with a plain space
    in front of it if there is one; an apostrophe that starts one, with an ending; white
    space up to the last character before something else; or that character.
    """
    n = len(codes)
    kind = kinds[codes]
    edge = np.zeros(n + 3, bool)
    edge[breaks] = True
    edge[n:] = True
    begins = edge[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    # The last character of white space that something follows stands alone or joins it.
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~edge[1:n])
    begins[last] = True
    begins[last[codes[last] == 32] + 1] = False
    quote = np.flatnonzero(begins & (codes == 39))
    following = np.concatenate([codes, np.zeros(2, codes.dtype)])
    for ending in ENDINGS:
        size = len(ending)
        hit = quote
        for k, c in enumerate(ending, 1):
            hit = hit[(following[hit + k] == ord(c)) & ~edge[hit + k]]
        begins[hit + 1] = False
        after = hit + 1 + size
        begins[after[after < n]] = True
    return begins


def _widths(codes: np.ndarray) -> np.ndarray:
    """Bytes of every code point in UTF-8."""
    return 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)


def split_texts(texts: list[str], kinds: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in UTF-8; where each pre-token begins in it, in bytes, and in code points
    (both with the end); and the index of each text's first pre-token (and their number)."""
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    breaks = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    if not len(codes):
        none = np.zeros(1, np.int64)
        return b"", none, none, np.zeros(len(texts) + 1, np.int64)
    begins = begins_of_words(codes, breaks, kinds)
    points = np.append(np.flatnonzero(begins), len(codes))
    offset = np.concatenate(([0], np.cumsum(_widths(codes), dtype=np.int64)))
    return joined.encode(), offset[points], points, np.searchsorted(points, breaks)


# -- merges -----------------------------------------------------------------

class Ranks:
    """The tokens of a rank file: lines of a token in base 64 and its rank."""

    def __init__(self, content: bytes):
        lines = (line.split() for line in content.splitlines() if line)
        self.rank = {base64.b64decode(token): int(rank) for token, rank in lines}
        tokens = [b""] * (max(self.rank.values()) + 1)
        for token, rank in self.rank.items():
            tokens[rank] = token
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        # The library gets pre-tokens line by line.
        self.library = tiktoken.Encoding(
            "lines", pat_str=r"[^\n]+", mergeable_ranks=self.rank, special_tokens={})

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one behind the other, and how many each has. They are merged by
        the library in one call; where a word ends follows from the size of its tokens.
        Words with a line feed (white space) go one by one."""
        odd = [i for i, w in enumerate(words) if b"\n" in w]
        plain = [w for w in words if b"\n" not in w] if odd else words
        ids = np.array(self.library.encode_ordinary(b"\n".join(plain).decode()), np.int64)
        ends = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))
        counts = np.diff(np.searchsorted(np.cumsum(self.sizes[ids]), ends, "left") + 1, prepend=0)
        if not odd:
            return ids, counts
        each = [self.library._encode_single_piece(words[i]) for i in odd]
        # Place of each odd word among the plain ones, and of its ids among theirs.
        among = np.array(odd) - np.arange(len(odd))
        before = np.concatenate(([0], np.cumsum(counts)))[among]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        ids = np.insert(ids, np.repeat(before, sizes), np.concatenate(each))
        return ids, np.insert(counts, among, sizes)


@lru_cache(1)
def _ranks(content: bytes) -> Ranks:
    return Ranks(content)


def _distinct(raw: bytes, cuts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Words among which equal short ones are found once, and the place of every pre-token
    among them. Words under 16 bytes are two whole numbers (the second with the size on
    top) and are grouped by a product of both; the few whose numbers differ from those of
    their group stand alone."""
    size = np.diff(cuts)
    short = np.flatnonzero(size < 16)
    data = np.frombuffer(raw + bytes(16), np.uint8)
    pair = np.ascontiguousarray(
        np.lib.stride_tricks.sliding_window_view(data, 16)[cuts[:-1][short]]).view("<u8")
    bits = 8 * size[short].astype(np.uint64)
    low = pair[:, 0] & _ones(np.minimum(bits, np.uint64(64)))
    high = pair[:, 1] & _ones(np.maximum(bits, np.uint64(64)) - np.uint64(64))
    high |= bits << np.uint64(53)
    with np.errstate(over="ignore"):
        mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))
    _, first, place = np.unique(mixed, return_index=True, return_inverse=True)
    same = (low == low[first][place]) & (high == high[first][place])
    alone = np.ones(len(size), bool)
    alone[short[same]] = False
    alone = np.flatnonzero(alone)
    out = np.empty(len(size), np.int64)
    out[short[same]] = place[same]
    out[alone] = len(first) + np.arange(len(alone))
    chosen = np.concatenate([short[first], alone])
    begin, end = cuts[:-1][chosen].tolist(), cuts[1:][chosen].tolist()
    return [raw[a:b] for a, b in zip(begin, end)], out


def _ones(bits: np.ndarray) -> np.ndarray:
    """Whole numbers with this many ones (0 to 64) at the low end."""
    shift = np.uint64(64) - np.maximum(bits, np.uint64(1))
    return np.where(bits > 0, np.uint64(2**64 - 1) >> shift, np.uint64(0))


def _spread(values: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``values`` (one behind the other, of these sizes) in the order of
    ``place``, and where each begins (and the end)."""
    start = np.cumsum(sizes) - sizes
    begin = np.concatenate(([0], np.cumsum(sizes[place])))
    source = np.repeat(start[place] - begin[:-1], sizes[place])
    return values[source + np.arange(begin[-1])], begin


class Words:
    """Ids of the words of one task: recent ones from memory (a bounded number of short
    words), others merged."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.seen: dict[bytes, bytes] = {}  # four bytes an id

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        each = list(map(self.seen.get, words))
        new = [i for i, ids in enumerate(each) if ids is None]
        if new:
            ids, counts = self.ranks.encode([words[i] for i in new])
            flat, ends = ids.astype(np.int32).tobytes(), (4 * np.cumsum(counts)).tolist()
            for i, a, b in zip(new, [0, *ends], ends):
                each[i] = flat[a:b]
            if len(self.seen) + len(new) > _MEMO_WORDS:
                self.seen.clear()
            self.seen.update((words[i], each[i]) for i in new[:_MEMO_WORDS] if len(words[i]) <= _MEMO_BYTES)
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        return np.frombuffer(b"".join(each), np.int32), sizes


def encode_words(known: Words, raw: bytes, cuts: np.ndarray, first: np.ndarray):
    """Ids of the pre-tokens that ``cuts`` marks in ``raw``, and where those of each text,
    given by the index of its first pre-token, begin (and the end)."""
    words, place = _distinct(raw, cuts)
    ids, begin = _spread(*known.encode(words), place)
    return ids, begin[first]


def decode_texts(ranks: Ranks, ids: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """Bytes of the ids of each text, concatenated."""
    data, at = _spread(ranks.data, ranks.sizes, ids)
    raw, cuts = data.tobytes(), at[begin].tolist()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


# -- tables -----------------------------------------------------------------

def encode_documents(
    docs: DataFrame, rank_file: str, text: str = "text", stride: int = STRIDE, overlap: int = OVERLAP
) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` and ``decoded`` (bytes).

    ``rank_file`` is the path of a rank file as the tiktoken library reads it, on the
    driver; the workers get its content (under 1 MB) and the kinds of characters (1 MB).
    Whole texts are encoded, without special tokens; a null text counts as empty. Every
    input row gives one output row; columns with the names of the new ones are replaced,
    others pass through.
    """
    if not _LOOKAHEAD < overlap <= stride:
        raise ValueError(f"overlap must lie between {_LOOKAHEAD + 1} and the stride")
    docs = docs.drop(*[f.name for f in NEW])
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(rank_file, "rb") as f:
        shared = spark.sparkContext.broadcast((f.read(), character_kinds()))
    is_long = F.coalesce(F.char_length(text) > stride + overlap, F.lit(False))
    return _encode_short(docs.where(~is_long), text, shared).unionByName(
        _encode_long(spark, docs.where(is_long), text, shared, stride, overlap))


def _encode_short(docs: DataFrame, text: str, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, kinds = _ranks(shared.value[0]), np.frombuffer(shared.value[1], np.uint8)
        known = Words(ranks)
        for batch in batches:
            for part in _slices(batch, text):
                raw, cuts, _, first = split_texts([t or "" for t in part[text].to_pylist()], kinds)
                ids, begin = encode_words(known, raw, cuts, first)
                decoded = pa.array(decode_texts(ranks, ids, begin), pa.binary())
                new = [pa.array(np.diff(begin)), pa.ListArray.from_arrays(begin.astype(np.int32), ids), decoded]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *new], names=[*part.schema.names, *(f.name for f in NEW)])

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + NEW))


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``_TOGETHER`` bytes of text."""
    ends = np.cumsum(pc.binary_length(batch[text]).fill_null(0).to_numpy(), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + _TOGETHER, "right")))
        yield batch.slice(at, to - at)
        at = to


def _encode_long(
    spark: SparkSession, docs: DataFrame, text: str, shared, stride: int, overlap: int
) -> DataFrame:
    """Long texts, whose chunks are spread over all tasks. The rows are stored once with a
    number, by which the chunks come together again."""
    rows = materialize(docs.select(
        F.monotonically_increasing_id().alias("key"), F.struct(*docs.columns).alias("row")), "bpe_long")
    fields = "key long, chunk int, start long, own long, last boolean, body string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, body in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                n = max(1, -(-(len(body) - overlap) // stride))
                for c in range(n):
                    last, a = c == n - 1, c * stride
                    yield pa.RecordBatch.from_pylist([{
                        "key": key, "chunk": c, "start": a, "own": len(body) - a if last else stride,
                        "last": last, "body": body[a:] if last else body[a : a + stride + overlap]}],
                        schema=kinds_schema)

    kinds_schema = pa.schema([("key", pa.int64()), ("chunk", pa.int32()), ("start", pa.int64()),
                              ("own", pa.int64()), ("last", pa.bool_()), ("body", pa.string())])
    chunks = rows.select("key", F.col("row")[text].alias("body")).mapInArrow(cut, fields)
    chunks = materialize(_split(chunks.repartition("key", "chunk"), shared, overlap), "bpe_chunks")
    while (stitches := _stitch(chunks)).where("apart").limit(1).count():
        chunks = materialize(_fuse(chunks, stitches, shared, overlap), "bpe_chunks")
    return _gather(rows, _encode_chunks(chunks.join(stitches, ["key", "chunk"]), shared), docs.columns)


def _split(chunks: DataFrame, shared, overlap: int) -> DataFrame:
    """Chunks with ``sizes`` (code points of every pre-token), ``head`` (boundaries that the
    chunk before may share) and ``tail`` (sure ones that the next chunk may share), both as
    places in the text."""
    new = {"sizes": pa.list_(pa.int32()), "head": pa.list_(pa.int64()), "tail": pa.list_(pa.int64())}
    kinds_of = T.ArrayType(T.LongType())
    schema = T.StructType(chunks.schema.fields + [
        T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("head", kinds_of), T.StructField("tail", kinds_of)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = np.frombuffer(shared.value[1], np.uint8)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                body, start, own = (row[c][0].as_py() for c in ("body", "start", "own"))
                _, _, points, _ = split_texts([body], kinds)
                sure = points[(points >= own) & (points + _LOOKAHEAD <= len(body))]
                added = (np.diff(points), start + points[points <= overlap],
                         sure[:0] if row["last"][0].as_py() else start + sure)
                yield pa.RecordBatch.from_arrays(
                    [*row.columns, *(pa.array([v.tolist()], t) for v, t in zip(added, new.values()))],
                    names=[*row.schema.names, *new])

    return chunks.mapInArrow(run, schema)


def _stitch(chunks: DataFrame) -> DataFrame:
    """Per ``key, chunk`` the places ``low`` and ``high`` between which its pre-tokens count;
    ``apart`` where a chunk and its successor have no boundary in common. The texts take no
    part in this."""
    w = Window.partitionBy("key").orderBy("chunk")
    meets = F.array_min(F.array_intersect("tail", F.lead("head").over(w)))
    out = chunks.select("key", "chunk", "start", "own", "last", meets.alias("meets"))
    return out.select(
        "key", "chunk", F.coalesce(F.lag("meets").over(w), "start").alias("low"),
        F.when(F.col("last"), F.col("start") + F.col("own")).otherwise(F.col("meets")).alias("high"),
        (~F.col("last") & F.col("meets").isNull()).alias("apart"))


def _fuse(chunks: DataFrame, stitches: DataFrame, shared, overlap: int) -> DataFrame:
    """Every run of chunks that are apart as one chunk, split again; others as they are."""
    w = Window.partitionBy("key").orderBy("chunk")
    runs = stitches.withColumn("before", F.coalesce(F.lag("apart").over(w), F.lit(False))).select(
        "key", "chunk", (F.col("apart") | F.col("before")).alias("joined"),
        F.max(F.when(~F.col("before"), F.col("chunk"))).over(w).alias("head_of"))
    marked = chunks.join(runs, ["key", "chunk"])
    parts = F.array_sort(F.collect_list(F.struct("chunk", "start", "own", "last", "body")))
    fused = marked.where("joined").groupBy("key", "head_of").agg(parts.alias("p"))
    body = F.array_join(F.transform("p", lambda x: F.when(
        x["chunk"] == F.element_at("p", -1)["chunk"], x["body"]).otherwise(
        F.substring(x["body"], F.lit(1), x["own"].cast("int")))), "")
    fused = fused.select(
        "key", F.col("head_of").alias("chunk"), F.col("p")[0]["start"].alias("start"),
        (F.element_at("p", -1)["start"] + F.element_at("p", -1)["own"] - F.col("p")[0]["start"]).alias("own"),
        F.element_at("p", -1)["last"].alias("last"), body.alias("body"))
    rest = marked.where("NOT joined").select(*fused.columns, "sizes", "head", "tail")
    return rest.unionByName(_split(fused, shared, overlap))


def _encode_chunks(stitched: DataFrame, shared) -> DataFrame:
    """``key, chunk, ids, decoded`` of the pre-tokens of each chunk that count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(shared.value[0])
        known = Words(ranks)
        for batch in batches:
            for row in batch.to_pylist():
                points = row["start"] + np.concatenate(([0], np.cumsum(row["sizes"], dtype=np.int64)))
                points = points[(points >= row["low"]) & (points <= row["high"])] - row["start"]
                counted = row["body"][points[0] : points[-1]]
                raw, cuts = _bytes_at(counted, points - points[0])
                ids, begin = encode_words(known, raw, cuts, np.array([0, len(points) - 1]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["key"]]), pa.array([row["chunk"]], pa.int32()),
                    pa.array([ids.tolist()], pa.list_(pa.int32())), pa.array(decode_texts(ranks, ids, begin), pa.binary()),
                ], names=["key", "chunk", "ids", "decoded"])

    return stitched.select("key", "chunk", "start", "low", "high", "body", "sizes").mapInArrow(
        run, "key long, chunk int, ids array<int>, decoded binary")


def _bytes_at(text: str, points: np.ndarray) -> tuple[bytes, np.ndarray]:
    """A text in UTF-8 and places in it, given in code points, in bytes."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return text.encode(), np.concatenate(([0], np.cumsum(_widths(codes), dtype=np.int64)))[points]


def _gather(rows: DataFrame, parts: DataFrame, columns: list[str]) -> DataFrame:
    """One row per text again, its parts in order."""
    whole = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids", "decoded"))).alias("p"))
    joined = rows.join(whole, "key")
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    # Stitches lie between characters, so every part is UTF-8 by itself.
    decoded = F.array_join(F.transform("p", lambda x: x["decoded"].cast("string")), "").cast("binary")
    return joined.select(
        *[F.col("row")[c].alias(c) for c in columns],
        F.size(ids).cast("bigint").alias("n_tokens"), ids.alias("ids"), decoded.alias("decoded"))
