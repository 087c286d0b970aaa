"""Byte-level BPE by a minimal acyclic transducer of frequent words.

Words (pre-tokens) are counted over the whole corpus. The most frequent ones are encoded
by exact merges and compiled into a minimal acyclic automaton: words with equal rests
share states. Every arc carries the number of words that sort before it, so the sum along
a path is the word's rank, which points to its ids. The arrays are shipped as one file and
memory-mapped by each Python worker, shared by all workers of a machine. All words of a
batch walk the automaton at once, one byte position at a time. Words outside the lexicon
are merged exactly.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from textlab.llm.common import bounded_batches, tidy
from textlab.sources.storage import materialize, shared_dir, write_file

LEXICON_WORDS = 65_536
# Counts kept per task while words are counted; see `word_counts`.
COUNTER_WORDS = 200_000
_CHUNK = 1 << 19
_MEMO_WORDS = 100_000
_NONE = np.int32(2**31 - 1)
# Words up to this many bytes are merged side by side, so many at a time.
_LONG = 40
_SIDE_BY_SIDE = 4096
# The endings that the pre-tokenizer splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


# -- pre-tokens -------------------------------------------------------------

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    out = np.zeros(0x110000, np.uint8)
    newer = []
    letters, numbers = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LN":
            out[c] = _LETTER if kind[0] == "L" else _NUMBER
        elif kind == "Cn" and (letters.match(chr(c)) or numbers.match(chr(c))):
            newer.append(c)
    # Python's tables may be older and the regex module's newer than the library's.
    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for c in newer:
        if len(split("a" + chr(c))) == 1:
            out[c] = _LETTER
        elif len(split("1" + chr(c))) == 1:
            out[c] = _NUMBER
    # The code points with the Unicode property White_Space.
    spaces = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[spaces] = _SPACE
    return out


def starts_of_words(codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where words start in a sequence of code points.

    A word is a run of letters, of numbers or of other characters, with one space before
    it if there is one; a run of white space without the last character if anything
    follows; or an apostrophe with one of the endings at the start of a word. ``breaks``
    are positions at which a text starts: nothing reaches over them.
    """
    n = len(codes)
    kind = _classes()[codes]
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new[breaks[breaks < n]] = True
    begins = new.copy()
    # A run of white space gives its last character away if something follows it.
    at = np.flatnonzero(new)
    ends = np.append(at[1:], n)
    space = kind[at] == _SPACE
    is_break = np.zeros(n + 1, bool)
    is_break[breaks] = True
    is_break[n] = True
    given = ends[space & ~is_break[ends]] - 1
    begins[given] = True
    # A plain space joins the word after it; any other white space is a word by itself.
    joins = given[codes[given] == 32]
    begins[joins + 1] = False
    return _split_endings(codes, begins, is_break)


def _split_endings(codes, begins, is_break):
    """Apostrophes at the start of a word take one of the endings with them."""
    n = len(codes)
    quotes = np.flatnonzero((codes == 39) & begins)
    for q in quotes.tolist():
        tail = "".join(map(chr, codes[q + 1 : q + 3].tolist()))
        for e in ENDINGS:
            stop = q + 1 + len(e)
            if tail.startswith(e) and stop <= n and not is_break[q + 1 : stop].any():
                begins[q + 1 : stop] = False
                begins[stop : stop + 1] = True
                break
    return begins


def split_words(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, the byte position of each word (and the end), and the
    index of each text's first word (and the number of words)."""
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    breaks = np.concatenate(([0], np.cumsum(sizes)))
    if not len(codes):
        return b"", np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    begins = starts_of_words(codes, breaks)
    width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    offset = np.concatenate(([0], np.cumsum(width)))
    words = np.concatenate(([0], np.cumsum(begins)))
    return joined.encode(), np.append(offset[:-1][begins], offset[-1]), words[breaks]


# -- exact merges -----------------------------------------------------------

class Merges:
    """The merge rules of a tokenizer file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        names = _byte_names()
        back = {c: b for b, c in names.items()}
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.byte_id = [vocab[names[b]] for b in range(256)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(pairs)}
        top = max([*vocab.values(), *self.special.values()])
        self.tokens = [b""] * (top + 1)
        for token, i in vocab.items():
            self.tokens[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()

        self.width = top + 1
        order = sorted(self.rank.items())
        self._pairs = np.array([a * self.width + b for (a, b), _ in order], np.int64)
        self._ranks = np.array([r for _, (r, _) in order], np.int32)
        self._merged = np.empty(len(order), np.int32)
        for _, (r, merged) in order:
            self._merged[r] = merged

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of every pair, _NONE where no rule has it."""
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where((self._pairs[at] == key) & (a >= 0) & (b >= 0), self._ranks[at], _NONE)

    def encode(self, word: bytes) -> list[int]:
        """Ids of one word: the best-ranked adjacent pair is merged, leftmost first, until
        no pair has a rule."""
        return self._encode_long([self.byte_id[b] for b in word])

    def encode_many(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of many words, merged side by side: each round merges the best pair of
        every word that still has one. Long words go one by one."""
        out: list = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(sizes > _LONG).tolist():
            out[i] = np.array(self.encode(words[i]), np.int32)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] <= _LONG]
        for at in range(0, len(order), _SIDE_BY_SIDE):
            rows = order[at : at + _SIDE_BY_SIDE]
            width = int(sizes[rows[-1]])
            data = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in rows), np.uint8)
            ids = np.array(self.byte_id, np.int32)[data].reshape(len(rows), width)
            ids[np.arange(width) >= sizes[rows][:, None]] = -1
            self._merge(ids)
            for i, row, n in zip(rows.tolist(), ids, (ids >= 0).sum(axis=1).tolist()):
                out[i] = row[:n].copy()
        return out

    def _merge(self, ids: np.ndarray) -> None:
        """Merge every row in place; rows end in -1."""
        n, width = ids.shape
        if width < 2:
            return
        pairs = self._ranks_of(ids[:, :-1], ids[:, 1:])
        live = np.arange(n)
        columns = np.arange(width)
        work = ids
        while True:
            best = pairs.argmin(axis=1)
            rank = pairs[np.arange(len(best)), best]
            go = rank < _NONE
            if not go.all():
                ids[live[~go]] = work[~go]
                live, work, pairs, best, rank = live[go], work[go], pairs[go], best[go], rank[go]
            if not len(live):
                return
            rows = np.arange(len(live))
            # What stands behind the pair moves up by one place.
            take = np.minimum(columns + (columns > best[:, None]), width - 1)
            work = np.take_along_axis(work, take, 1)
            work[:, -1] = -1
            work[rows, best] = self._merged[rank]
            pairs = np.take_along_axis(pairs, np.minimum(take[:, :-1], width - 2), 1)
            pairs[:, -1] = _NONE
            left = np.flatnonzero(best > 0)
            pairs[left, best[left] - 1] = self._ranks_of(
                work[left, best[left] - 1], work[left, best[left]])
            right = np.flatnonzero(best < width - 1)
            pairs[right, best[right]] = self._ranks_of(
                work[right, best[right]], work[right, best[right] + 1])

    def _encode_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and linked neighbours, for words of any length."""
        import heapq

        n, rank = len(ids), self.rank
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*rank[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, merged, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merged, -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (found := rank.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (*found, x, ids[x], ids[y]))
        return [t for t in ids if t >= 0]


def _byte_names() -> dict[int, str]:
    """Printable character that stands for each byte in a byte-level vocabulary: itself,
    or the next free one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


# -- the transducer ---------------------------------------------------------

def compile_lexicon(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of distinct words as dense arrays.

    Words come in sorted order; once a branch is left, its states are replaced by equal
    ones already registered, so states with the same arcs exist once. ``next`` and
    ``skip`` hold, for state * n_classes + class of a byte, the following state (0: none)
    and the number of words in front of that arc; ``ends`` marks final states.
    """
    register: dict[tuple, int] = {}
    finals, arcs, sizes = [False], [()], [0]  # state 0: dead
    path: list[tuple[bool, list]] = [(False, [])]  # (final, arcs) of the open branch

    def close(depth: int) -> None:
        while len(path) > depth:
            final, own = path.pop()
            key = (final, tuple(own))
            state = register.get(key)
            if state is None:
                state = register[key] = len(finals)
                finals.append(final)
                arcs.append(key[1])
                sizes.append(final + sum(sizes[t] for _, t in own))
            byte = path[-1][1][-1][0] if path else None
            if path:
                path[-1][1][-1] = (byte, state)

    last = b""
    for word in sorted(set(words)):
        common = os.path.commonprefix([last, word])
        close(len(common) + 1)
        for byte in word[len(common):]:
            path[-1][1].append((byte, -1))
            path.append((False, []))
        path[-1] = (True, path[-1][1])
        last = word
    close(0)
    used = sorted({b for own in arcs for b, _ in own})
    classes = np.zeros(256, np.int32)
    classes[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1
    follow = np.zeros((len(finals), width), np.int32)
    skip = np.zeros((len(finals), width), np.int32)
    for state, own in enumerate(arcs):
        before = int(finals[state])
        for byte, to in own:
            follow[state, classes[byte]], skip[state, classes[byte]] = to, before
            before += sizes[to]
    return {"next": follow.ravel(), "skip": skip.ravel(), "ends": np.array(finals, bool),
            "classes": classes, "start": np.array([len(finals) - 1], np.int32)}


def lexicon_bytes(words: list[bytes], merges: Merges) -> bytes:
    """The automaton of the words and their ids as the content of a file of aligned arrays."""
    words = sorted(set(words))
    parts = compile_lexicon(words)
    ids = merges.encode_many(words)
    parts["at"] = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int64)
    parts["ids"] = np.concatenate(ids or [np.zeros(0, np.int32)])
    head, offset = {}, 0
    for name, array in parts.items():
        head[name] = (str(array.dtype), offset, len(array))
        offset += -(-array.nbytes // 64) * 64
    lead = json.dumps(head).encode()
    lead = len(lead).to_bytes(8, "little") + lead
    arrays = [array.tobytes() + b"\0" * (-array.nbytes % 64) for array in parts.values()]
    return b"".join([lead, b"\0" * (-len(lead) % 64), *arrays])


class Lexicon:
    """A memory-mapped lexicon file."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        n = int(whole[:8].view("<u8")[0])
        base = -(-(8 + n) // 64) * 64
        for name, (kind, offset, size) in json.loads(bytes(whole[8 : 8 + n])).items():
            at = base + offset
            setattr(self, name, whole[at : at + size * np.dtype(kind).itemsize].view(kind))
        self.width = len(self.next) // len(self.ends)

    def lookup(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rank of every word ``data[starts[i]:starts[i + 1]]``, -1 where it is unknown."""
        size = np.diff(starts)
        order = np.argsort(-size, kind="stable")
        at, long = starts[:-1][order], size[order]
        state = np.full(len(order), self.start[0], np.int32)
        rank = np.zeros(len(order), np.int32)
        classes = self.classes[data]
        live = np.searchsorted(-long, -np.arange(1, long[0] + 1), "right") if len(long) else []
        for step, n in enumerate(live):
            arc = state[:n] * self.width + classes[at[:n] + step]
            rank[:n] += self.skip[arc]
            state[:n] = self.next[arc]
            if not state[:n].any():
                break
        out = np.empty(len(order), np.int64)
        known = self.ends[state] & (state > 0)
        out[order] = np.where(known, rank, -1)
        return out


# -- encoding and decoding batches ------------------------------------------

class Coder:
    """Encodes and decodes texts in one Python worker."""

    def __init__(self, merges: Merges, lexicon: Lexicon):
        self.merges, self.lexicon = merges, lexicon
        self.seen: dict[bytes, bytes] = {}  # ids as four bytes each

    def _unknown(self, words: list[bytes]) -> list[bytes]:
        """Ids of words outside the lexicon; recent ones are remembered."""
        seen = self.seen
        new = [w for w in dict.fromkeys(words) if w not in seen]
        if len(seen) + len(new) > _MEMO_WORDS:
            seen.clear()
            new = list(dict.fromkeys(words))
        seen.update(zip(new, (ids.tobytes() for ids in self.merges.encode_many(new))))
        return [seen[w] for w in words]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text. Contents of special tokens get their id."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= _CHUNK):
                size += len(texts[to])
                to += 1
            out += self._encode(texts[at:to])
            at = to
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        special = self.merges.special
        if any(s in t for s in special for t in texts):
            pieces = [_cut_special(t, special) for t in texts]
            plain = iter(self._plain([p for ps in pieces for p in ps if isinstance(p, str)]))
            return [np.concatenate([
                next(plain) if isinstance(p, str) else np.array([p], np.int32) for p in ps
            ]) for ps in pieces]
        return self._plain(texts)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        raw, starts, first = split_words(texts)
        data, lex = np.frombuffer(raw, np.uint8), self.lexicon
        rank = lex.lookup(data, starts)
        count = np.where(rank >= 0, lex.at[rank + 1] - lex.at[rank], 0)
        missing = np.flatnonzero(rank < 0)
        other = self._unknown([raw[a:b] for a, b in zip(
            starts[missing].tolist(), starts[missing + 1].tolist())])
        count[missing] = np.fromiter(map(len, other), np.int64, len(other)) // 4
        begin = np.concatenate(([0], np.cumsum(count)))
        ids = np.empty(begin[-1], np.int32)
        known = np.repeat(rank >= 0, count)
        source = np.repeat(np.where(rank >= 0, lex.at[rank], 0) - begin[:-1], count)
        ids[known] = lex.ids[(source + np.arange(begin[-1]))[known]]
        if other:
            ids[~known] = np.frombuffer(b"".join(other), np.int32)
        cuts = begin[first]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def decode(self, ids: np.ndarray) -> str:
        """Text of a sequence of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.merges.tokens.__getitem__, ids.tolist())).decode(errors="replace")


def _cut_special(text: str, special: dict[str, int]) -> list:
    """A text as strings and ids of special tokens, the first match from the left, the
    longest one there."""
    pattern = "|".join(map(re.escape, sorted(special, key=len, reverse=True)))
    out, at = [], 0
    for m in re.finditer(pattern, text):
        if m.start() > at:
            out.append(text[at : m.start()])
        out.append(special[m.group()])
        at = m.end()
    return [*out, text[at:]] if at < len(text) or not out else out


# -- over a corpus ----------------------------------------------------------

def word_counts(texts: DataFrame, text: str, keep: int = COUNTER_WORDS) -> DataFrame:
    """``word`` (bytes), ``n``: counts of the frequent words of all texts.

    Each task keeps at most ``keep`` words: when there are more, the count at that place
    is taken from all of them. A count is too low by at most (words read) / ``keep``, and
    no word that is more frequent than that is missing; the lexicon only decides which
    words are looked up instead of merged, never their ids.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            rows = [t for t in batch[0].to_pylist() if t]
            for at in range(0, len(rows), 64):
                raw, starts, _ = split_words(rows[at : at + 64])
                cuts = starts.tolist()
                counts.update(map(raw.__getitem__, map(slice, cuts[:-1], cuts[1:])))
                if len(counts) > 2 * keep:
                    cut = sorted(counts.values(), reverse=True)[keep]
                    counts = Counter({w: n - cut for w, n in counts.items() if n > cut})
        top = counts.most_common(keep)
        for at in range(0, len(top), 10_000):
            words, n = zip(*top[at : at + 10_000])
            yield pa.RecordBatch.from_pydict({"word": list(words), "n": list(n)})

    return texts.select(text).mapInArrow(tidy(run), "word binary, n long").groupBy("word").agg(
        F.sum("n").alias("n"))


def lexicon_file(
    docs: DataFrame, tokenizer: str, text: str = "text", size: int = LEXICON_WORDS
) -> str:
    """Compile the most frequent words of a corpus, at most ``size``, and ship the file to
    the executors; returns its name there. How frequent a word must be follows from a
    histogram of the logarithm of the counts, so the driver sees that and at most ``size``
    words, however many tasks count."""
    with open(tokenizer, encoding="utf-8") as f:
        merges = Merges(json.load(f))
    level = F.floor(F.log2("n") * 16)
    counts = materialize(
        word_counts(docs, text).where(F.length("word") <= 64).withColumn("level", level),
        "bpe_words")
    total, whole, split = 0, [], None
    for r in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        if total + r["count"] > size:
            split = r["level"]  # of this one the most frequent words that still fit
            break
        total += r["count"]
        whole.append(r["level"])
    top = counts.where(F.col("level").isin(whole)).select("word").collect()
    if split is not None and total < size:
        part = counts.where(F.col("level") == split).orderBy(F.desc("n"), "word")
        top += part.limit(size - total).select("word").collect()
    name, spark = f"lexicon-{uuid.uuid4().hex}.bin", docs.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    write_file(spark, path, lexicon_bytes([bytes(r.word) for r in top], merges))
    spark.sparkContext.addFile(path)
    return name


@lru_cache(1)
def _merges(tokenizer_json: str) -> Merges:
    return Merges(json.loads(tokenizer_json))


ENCODED = "n_tokens long, ids array<int>, decoded string"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(
    docs: DataFrame, tokenizer: str, text: str = "text", digests: bool = False,
    lexicon_words: int = LEXICON_WORDS,
) -> DataFrame:
    """``docs`` with ``n_tokens`` and either ``ids`` and the ``decoded`` text or, with
    ``digests``, the SHA-256 of the ids (decimal, joined by commas) and of that text.

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library; it is
    read on the driver and sent to the workers (a few MB). Whole texts are encoded; a null
    text counts as empty. Every input row gives one output row; columns with the names of
    the new ones are replaced.
    """
    new = DIGESTS if digests else ENCODED
    names = [c.split()[0] for c in new.split(", ")]
    docs = docs.drop(*names)
    spark = docs.sparkSession
    bounded_batches(spark)
    lexicon = lexicon_file(docs, tokenizer, text, lexicon_words)
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Recent words are remembered for one task only.
        coder = Coder(_merges(spec.value), Lexicon(SparkFiles.get(lexicon)))
        for batch in batches:
            for part in _slices(batch, text):
                texts = [t or "" for t in part[text].to_pylist()]
                yield _result(part, coder, texts, digests)

    fields = spark.createDataFrame([], new).schema.fields
    return docs.mapInArrow(tidy(run), type(schema)(schema.fields + fields))


def _slices(batch: pa.RecordBatch, text: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``size`` bytes of text."""
    ends = np.cumsum(pc.binary_length(batch[text]).fill_null(0).to_numpy(), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _result(part: pa.RecordBatch, coder: Coder, texts: list[str], digests: bool):
    ids = coder.encode(texts)
    decoded = [coder.decode(i) for i in ids]
    columns = [pa.array([len(i) for i in ids], pa.int64())]
    names = [*part.schema.names, "n_tokens"]
    if digests:
        joined = (",".join(map(str, i.tolist())).encode() for i in ids)
        columns += [pa.array(map(_sha, joined), pa.string()),
                    pa.array([_sha(d.encode()) for d in decoded], pa.string())]
        names += ["ids_sha256", "decoded_sha256"]
    else:
        columns += [pa.array([i.tolist() for i in ids], pa.list_(pa.int32())),
                    pa.array(decoded, pa.string())]
        names += ["ids", "decoded"]
    return pa.RecordBatch.from_arrays([*part.columns, *columns], names=names)
