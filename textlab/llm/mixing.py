"""Mixing sources to target weights by blocks of words and permuted slots.

The words of a source form one stream, documents in a pseudorandom order, packed into
blocks of ``block_words`` words. The mix is a sequence of slots of one block each, cut into
output shards. A pseudorandom permutation of all slots deals them to the shards, which
draws the source counts of every shard at once: multinomial counts under the condition
that each source fills exactly its quota over all shards. Slot j of a source maps through
a permutation of the source's own block indices, and again from the start when all blocks
are used, so every block is taken as often as any other or once more. Slots and blocks
then meet in a join by (source, block index).

Permutations are keyed Feistel networks that are computed for any index on its own:
nothing is sorted or kept, and the same seed gives the same mix again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.functions.binding import let
from textlab.llm.common import WORD, tidy, word_count
from textlab.sources.storage import materialize

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 64
SHARD_SLOTS = 8192
MAX_REPEAT = 3
# Slots generated, and documents ordered, by one unit of work.
_SLOTS_A_ROW = 65_536
_BUCKETS = 1024


def permute(index: np.ndarray, size: int, key: int, inverse: bool = False) -> np.ndarray:
    """A keyed pseudorandom permutation of [0, size), applied to an array of indices.

    Four Feistel rounds on the next even number of bits; results outside the range are
    permuted again until they are inside.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                + np.uint64(key % 2**64))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in (keys[::-1] if inverse else keys):
            if inverse:
                left, right = right ^ (_mix(left + k) & mask), left
            else:
                left, right = right, left ^ (_mix(right + k) & mask)
        return (left << shift) | right

    out = once(index.astype(np.uint64))
    while (again := out >= np.uint64(size)).any():
        out[again] = once(out[again])
    return out.astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT
) -> DataFrame:
    """``source, source_size`` with ``source_no`` (0.. by code point, null last) and
    ``target``: the words the mix takes from the source.

    Weights repeat along the source order. The targets add up to all sizes; a target above
    ``max_repeat`` times its source stops there, and the excess is shared by weight among
    the others until none is above. A source without words gets 0. Each round of sharing
    is one aggregate over the table of sources.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    weight = F.element_at(
        F.array(*[F.lit(float(x)) for x in weights]),
        (F.col("source_no") % len(weights) + 1).cast("int"))
    rows = materialize(
        sizes.withColumn("source_no", (F.row_number().over(w) - 1).cast("bigint"))
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(max_repeat))), "mix_sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1
    while True:
        # Sources whose share at this level is above what they may give stop at that.
        full = F.col("weight") * F.lit(level) >= F.col("most")
        r = rows.agg(
            F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("given"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count_if(full).alias("n"),
        ).first()
        if not r["open"] or r["n"] == before:
            break
        level, before = (total - r["given"]) / r["open"], r["n"]
    target = F.least(F.col("weight") * F.lit(level), F.col("most"))
    return rows.withColumn("target", target).drop("weight", "most")


def placed(docs: DataFrame, targets: DataFrame, order: str, seed: int) -> DataFrame:
    """Documents (``source, size`` and the ordering key) with ``source_no`` and ``start``:
    words before them in the stream of their source.

    Sizes are summed per (source, bucket of the key); only those sums and the rows of one
    bucket are ordered, so no source is handled in one task.
    """
    keyed = docs.withColumn("_key", F.xxhash64(F.lit(seed), order))
    keyed = keyed.withColumn("_bucket", F.pmod(F.shiftrightunsigned("_key", 40), F.lit(_BUCKETS)))
    known = targets.select(
        F.col("source").alias("_source"), "source_no", "source_size", "target")
    keyed = keyed.join(F.broadcast(known) if _few(known) else known,
                       F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    sums = keyed.groupBy("source_no", "_bucket").agg(F.sum("size").alias("_sum"))
    w = Window.partitionBy("source_no").orderBy("_bucket")
    offsets = sums.withColumn("_offset", F.sum("_sum").over(w) - F.col("_sum")).drop("_sum")
    inside = Window.partitionBy("source_no", "_bucket").orderBy("_key", order, "size").rowsBetween(
        Window.unboundedPreceding, 0)
    return (
        keyed.withColumn("_upto", F.sum("size").over(inside))
        .join(offsets, ["source_no", "_bucket"])
        .withColumn("start", F.col("_offset") + F.col("_upto") - F.col("size"))
        .drop("_key", "_bucket", "_upto", "_offset")
    )


def _few(sources: DataFrame, limit: int = 10_000) -> bool:
    return len(sources.limit(limit + 1).collect()) <= limit


def quotas(targets: DataFrame, block_words: int) -> DataFrame:
    """Per source ``n_blocks``, ``n_slots``, ``rounds`` (times every block is used), ``rest``
    (words taken beyond them) and ``slots_before`` (slots of the sources before it)."""
    goal = F.round("target").cast("bigint")
    blocks = F.ceil(F.col("source_size") / block_words)
    w = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    return (
        targets.where("source_size > 0")
        .withColumn("goal", goal)
        .withColumn("n_blocks", blocks.cast("bigint"))
        .withColumn("rounds", F.floor(F.col("goal") / F.col("source_size")))
        .withColumn("rest", F.col("goal") - F.col("rounds") * F.col("source_size"))
        # Whole rounds take every block; the rest takes its words from further slots.
        .withColumn("n_slots", F.col("rounds") * F.col("n_blocks")
                    + F.ceil(F.col("rest") / block_words).cast("bigint"))
        .withColumn("slots_before", F.coalesce(F.sum("n_slots").over(w), F.lit(0)))
        .select("source_no", "source_size", "n_blocks", "n_slots", "rounds", "rest",
                "slots_before")
    )


def slots(plan: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """``shard, slot, source_no, block, words``: where each slot of the mix goes and how
    many leading words of which block it takes."""
    total = plan.agg(F.sum("n_slots")).first()[0] or 0
    steps = F.sequence(F.lit(0).cast("bigint"), F.col("n_slots") - 1, F.lit(_SLOTS_A_ROW).cast("bigint"))
    work = plan.where("n_slots > 0").select("*", F.explode(steps).alias("begin"))
    n = max(plan.sparkSession.sparkContext.defaultParallelism, total // (8 * _SLOTS_A_ROW))
    work = work.repartition(int(min(n, 1 << 20)))

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                j = np.arange(r.begin, min(r.begin + _SLOTS_A_ROW, r.n_slots), dtype=np.int64)
                block, words = _blocks_of(j, r, block_words, seed)
                where = permute(r.slots_before + j, total, seed, inverse=True)
                yield pd.DataFrame({
                    "shard": where // shard_slots, "slot": where % shard_slots,
                    "source_no": np.full(len(j), r.source_no, np.int64),
                    "block": block, "words": words,
                })

    return work.mapInPandas(tidy(fill), "shard long, slot long, source_no long, block long, words long")


def _blocks_of(j: np.ndarray, r, block_words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and words of the slots ``j`` of a source.

    Whole rounds take every block. The slots after them take full blocks in another
    permuted order, the last one only the words that are left; the short block at the end
    of the stream comes in when the full ones do not suffice.
    """
    key = seed * 7919 + 2 * (r.source_no + 1)
    block = permute(j % r.n_blocks, r.n_blocks, key)
    words = np.minimum(block_words, r.source_size - block * block_words)
    i = j - r.rounds * r.n_blocks
    full = r.source_size // block_words
    last = i >= 0
    if last.any():
        rest = i[last]
        block[last] = np.where(
            rest < full, permute(np.minimum(rest, max(full - 1, 0)), max(full, 1), key + 1), full)
        words[last] = np.minimum(block_words, r.rest - rest * block_words)
    return block, words


def taken(docs: DataFrame, blocks: DataFrame, block_words: int) -> DataFrame:
    """``source_no, start`` of documents and ``spans``: for every block they share words
    with, the first word (from 0 in the document), how many there are, and ``uses``: for
    each use of the block the words it takes, counted from the first one here."""
    first = F.floor(F.col("start") / block_words)
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = docs.where("size > 0").select(
        "source_no", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    skip = F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0))
    at = F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0))
    here = F.least(block_words - skip, F.col("size") - at)
    joined = pieces.join(blocks, ["source_no", "block"]).select(
        "source_no", "start", at.alias("at"), here.alias("n"),
        F.transform("uses", lambda u: F.greatest(
            F.lit(0).cast("bigint"), F.least(here, u - skip))).alias("uses"))
    return joined


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
    weights: Sequence[float] = WEIGHTS, block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS, max_repeat: int = MAX_REPEAT, seed: int = 17,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of a table of documents: ``(sized, spans, slots)``.

    ``sized`` has a row per document: ``doc_id, digest`` (of the text), ``source, size,
    source_no, source_size, target, start``. ``spans`` has, per document (by ``source_no,
    start``) and block, the words that each use of the block takes. ``slots`` is the plan
    of the output shards. Null texts have size 0; null sources are one source, the last.
    Null and repeated ids are allowed: documents are placed by id, text digest and size,
    and rows equal in all three are interchangeable.
    """
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.xxhash64(F.col(text)).alias("digest"), word_count(F.col(text)).alias("size"))
    sized = materialize(
        sized.withColumn("order", F.xxhash64("doc_id", "digest", "source")), "mix_sizes")
    targets = source_targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    targets = materialize(targets, "mix_targets")
    where = materialize(placed(sized, targets, "order", seed), "mix_placed")
    plan = quotas(targets, block_words)
    deal = materialize(slots(plan, block_words, shard_slots, seed), "mix_slots")
    # A block is used at most max_repeat times and once more, so the list is short.
    uses = deal.groupBy("source_no", "block").agg(F.sort_array(F.collect_list("words"), False).alias("uses"))
    return where, taken(where, uses, block_words), deal


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken`` for every document: its words,
    those of its source, the source's share of the mix, and the words the mix takes from
    the document, repeats counted."""
    where, spans, _ = mix(docs, **options)
    sums = spans.groupBy("source_no", "start").agg(
        F.sum(F.aggregate("uses", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("taken"))
    some, none = where.where("size > 0"), where.where("size = 0")
    columns = ["doc_id", "size", "source", "source_size", "target", "taken"]
    counted = some.join(sums, ["source_no", "start"], "left").withColumn(
        "taken", F.coalesce("taken", F.lit(0)))
    return counted.select(columns).unionByName(
        none.withColumn("taken", F.lit(0).cast("bigint")).select(columns))


def mixed_documents(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
    **options,
) -> DataFrame:
    """The mix as documents with the columns of ``docs``: a document taken r times (in
    part or whole) gives r rows, the k-th with the words of the blocks used at least k
    times, joined by one space. Documents of which nothing is taken are left out;
    ``n_chars`` follows the text if there is one."""
    where, spans, _ = mix(docs, text=text, doc_id=doc_id, source=source, **options)
    uses = spans.select(
        "source_no", "start", "at", F.posexplode("uses").alias("turn", "words")
    ).where("words > 0").groupBy("source_no", "start", "turn").agg(
        F.sort_array(F.collect_list(F.struct("at", "words"))).alias("spans"))
    keys = where.join(uses, ["source_no", "start"]).select("order", "turn", "spans", "start")
    # Rows equal in id, text and source share the order key; a number among them pairs each
    # with its own spans, by their other columns so that it is the same in every run.
    twin = Window.partitionBy("order").orderBy("start")
    at = where.where("size > 0").select("order", "start").withColumn("twin", F.row_number().over(twin))
    keys = keys.join(at, ["order", "start"]).drop("start")
    # The row in one piece, so that no column of it can meet those added here.
    order = F.xxhash64(doc_id, F.xxhash64(F.col(text)), F.col(source).cast("string"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), order.alias("order"))
    content = F.to_json("row")
    rows = rows.withColumn("twin", F.row_number().over(
        Window.partitionBy("order").orderBy(F.xxhash64(content), content)))
    words = F.regexp_extract_all(F.col("row")[text], F.lit(f"({WORD})"))
    joined = let(words, lambda w: F.array_join(F.flatten(F.transform(
        "spans", lambda s: F.slice(w, s["at"].cast("int") + 1, s["words"].cast("int")))), " "))
    out = rows.join(keys, ["order", "twin"]).select("row", joined.alias("joined"))
    new = {c: F.col("row")[c] for c in docs.columns} | {text: F.col("joined")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("joined").cast(docs.schema["n_chars"].dataType)
    return out.select(*[value.alias(c) for c, value in new.items()])
