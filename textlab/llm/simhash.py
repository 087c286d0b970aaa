"""Near-duplicates by SimHash; candidate pairs by pigeonring filtering.

The 64 bits are cut into ``m`` segments on a ring. If two fingerprints differ in at most
``tau`` bits, some segment starts a chain in which the first l segments together differ in
at most ``l * tau / m`` bits, for every l. While that budget is below one bit the segments
are equal, so they serve as the key of an equi-join; the rest of the chain is tested before
the full Hamming distance.

Work is on distinct fingerprints, so copies of one text cost nothing. A key shared by more
than ``hot`` distinct fingerprints is not joined: two of them differ in at most two free
bits exactly if they agree after some two of those bits are cleared, and after clearing at
most four distinct ones agree. That costs a fixed number of rows per fingerprint, however
many share the key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from textlab.llm.common import bounded_batches, components, give_back
from textlab.sources.storage import materialize

BITS = 64
TAU = 2
SEGMENTS = 5
HOT = 1024
SEED = 42
_CHUNK = 65_536


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the word shingles of a text as a signed 64-bit integer.

    A-Z are lower-cased, shingles repeat as often as they occur, a text of fewer words is
    one shingle, and a text without words (or null) gets 0. A bit is 1 if more than half
    of the shingle hashes have it.
    """
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist())
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(set_bits.view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    try:
        for texts in batches:
            yield texts.map(fingerprint).astype("int64")
    finally:
        give_back()


def fingerprint_of(text: Column) -> Column:
    """The SimHash of a text column as a long; null counts as empty."""
    return _fingerprints(F.coalesce(text, F.lit("")))


def widths(m: int) -> list[int]:
    return [BITS // m + (i < BITS % m) for i in range(m)]


def _mask(i: int, m: int) -> int:
    """Bits of segment i as a signed long."""
    w = widths(m)
    value = ((1 << w[i]) - 1) << sum(w[:i])
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def _masks(spark: SparkSession, exact: int, tau: int, m: int) -> DataFrame:
    """``start, mask``: for each start of a chain, every way to clear ``tau`` of the bits
    outside its first ``exact`` segments."""
    w, rows = widths(m), []
    for start in range(m):
        held = {(start + j) % m for j in range(exact)}
        free = [sum(w[:i]) + b for i in range(m) if i not in held for b in range(w[i])]
        for bits in combinations(free, tau):
            value = sum(1 << b for b in bits)
            rows.append((start, ~(value - (1 << BITS) if value >= 1 << (BITS - 1) else value)))
    return spark.createDataFrame(
        pd.DataFrame(rows, columns=["start", "mask"]).astype({"start": "int32"}))


def _chain(a: Column, b: Column, start: int, tau: int, m: int) -> Column:
    """The chain of segments that begins at ``start`` stays within its budgets."""
    ok, total = F.lit(True), F.lit(0)
    for length in range(1, m + 1):
        mask = F.lit(_mask((start + length - 1) % m, m))
        total = total + F.bit_count(a.bitwiseXOR(b).bitwiseAND(mask))
        if length * tau // m or length == m:
            ok = ok & (total <= length * tau // m)
    return ok


def links(fps: DataFrame, tau: int = TAU, m: int = SEGMENTS, hot: int = HOT) -> DataFrame:
    """Edges ``src, dst`` whose components are those of all pairs of distinct values of the
    column ``fp`` with a Hamming distance of at most ``tau`` (at most 2)."""
    if not 0 < tau <= 2:
        raise ValueError("tau is 1 or 2")
    exact = max(length for length in range(1, m) if length * tau // m == 0)
    keys = []
    for start in range(m):
        mask = 0
        for j in range(exact):
            mask |= _mask((start + j) % m, m)
        keys.append(F.struct(F.lit(start).alias("start"),
                             F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    keyed = fps.select("fp", F.inline(F.array(*keys)))
    sizes = keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = materialize(keyed.join(sizes, ["start", "key"]), "simhash_keys")

    cold = keyed.where(F.col("n") <= hot)
    a, b = cold.alias("a"), cold.select("start", "key", F.col("fp").alias("other")).alias("b")
    chain = F.lit(False)
    for start in range(m):
        chain = chain | ((F.col("a.start") == start)
                         & _chain(F.col("a.fp"), F.col("b.other"), start, tau, m))
    apart = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.other"))) <= tau
    same_key = (F.col("a.start") == F.col("b.start")) & (F.col("a.key") == F.col("b.key"))
    pairs = a.join(b, same_key & (F.col("a.fp") < F.col("b.other")) & chain & apart).select(
        F.col("a.fp").alias("src"), F.col("b.other").alias("dst"))

    masks = F.broadcast(_masks(fps.sparkSession, exact, tau, m))  # a fixed number of rows
    groups = (
        keyed.where(F.col("n") > hot).join(masks, "start")
        .groupBy("start", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"))
        .agg(F.collect_set("fp").alias("fps"))  # at most 2 ** tau of them agree
        .where(F.size("fps") > 1)
    )
    stars = groups.select(F.array_min("fps").alias("src"), F.explode("fps").alias("dst"))
    return pairs.unionByName(stars.where("src != dst"))


def simhash_groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tau: int = TAU
) -> DataFrame:
    """``doc_id, fp, fingerprint, component_id`` for every row of ``docs``.

    ``fp`` is the fingerprint as a long, ``fingerprint`` its 16 hex digits, and
    ``component_id`` the smallest id reachable over fingerprints that differ in at most
    ``tau`` bits. Copies and texts without words (fingerprint 0) are linked like any
    other. A repeated row is returned as often as it occurs. Rows with a null id take
    part; ``component_id`` is null only where no row of the component has an id.
    """
    return _labelled(docs, text, doc_id, tau).select(
        "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _labelled(docs: DataFrame, text: str, doc_id: str, tau: int) -> DataFrame:
    """``doc_id, fp, label, component_id`` for every row; ``label`` tells components apart
    whose smallest ids are equal."""
    bounded_batches(docs.sparkSession)
    hashed = docs.select(F.col(doc_id).alias("doc_id"), fingerprint_of(F.col(text)).alias("fp"))
    fps = materialize(hashed, "simhash_fps")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    label = components(links(distinct.select("fp"), tau), "simhash_components")
    labelled = distinct.join(label, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("label"))
    ids = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = labelled.join(ids, "label").select("fp", "label", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "label", "component_id")


def one_per_group(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tau: int = TAU
) -> DataFrame:
    """The rows of ``docs`` that represent their near-duplicate group: the one with the
    smallest id, of several such rows one with the smallest fingerprint, then by the digests
    of the text and of the other columns, so that every run keeps the same one. An id with
    texts of several groups may represent each of them. Rows with a null id are kept."""
    groups = _labelled(docs, text, doc_id, tau)
    stay = groups.where("doc_id = component_id").groupBy("label").agg(
        F.min(F.struct("doc_id", "fp")).alias("least")).select("least.doc_id", "least.fp")
    # The row in one piece, so that no column of it can meet those added here.
    row = F.struct(*docs.columns).alias("row")
    named = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), fingerprint_of(F.col(text)).alias("fp"), row)
    same = [F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind]  # maps have no hash
    order = F.struct(F.sha2(F.coalesce(F.col("row")[text], F.lit("")), 256), F.xxhash64(*same))
    kept = named.join(stay, ["doc_id", "fp"], "left_semi").groupBy("doc_id", "fp").agg(
        F.min_by("row", order).alias("row"))
    return kept.select("row.*").unionByName(docs.where(F.col(doc_id).isNull()))
