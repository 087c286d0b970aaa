import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.llm import mixing
from textlab.llm.queries import op10_mixing


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = {s for s in names if not sizes[s]}
    total = sum(sizes.values())
    while True:
        free = total - sum(most * sizes[s] for s in full)
        share = sum(w[s] for s in names if s not in full)
        got = {s: most * sizes[s] if s in full else free * w[s] / share for s in names}
        over = {s for s in names if s not in full and got[s] >= most * sizes[s]}
        if not over:
            return got
        full |= over


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 1000])
def test_permutation(size):
    out = mixing.permute(np.arange(size), size, 99)
    assert sorted(out.tolist()) == list(range(size))
    assert mixing.permute(out, size, 99, inverse=True).tolist() == list(range(size))
    if size > 100:
        assert out.tolist() != mixing.permute(np.arange(size), size, 98).tolist()


def corpus(rng):
    rows = [(i, " ".join(rng.choices("ab", k=rng.choice([0, 1, 5, 70, 400]))), rng.choice("pqrs"))
            for i in range(120)]
    rows += [(3, "tiny words", "t"), (None, "no id here", None), (5, None, "u"), (7, "x " * 3000, "v")]
    return rows + [rows[4], rows[4], (4, "other text", rows[4][2])]


@pytest.mark.parametrize("block_words", [7, 64])
def test_counts_by_brute_force(spark, documents, block_words):
    rows = corpus(random.Random(5))
    df = documents(rows, extra=True).withColumnRenamed("source", "src").selectExpr("*", "src AS source")
    got = mixing.mix_counts(df, block_words=block_words).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    targets, taken = slow_targets(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 1
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    again = mixing.mix_counts(df.repartition(3), block_words=block_words).collect()
    assert Counter(got) == Counter(again)


def test_documents_of_the_mix(spark, documents):
    df = documents(corpus(random.Random(6)), extra=True)
    counts = mixing.mix_counts(df, block_words=16)
    out = mixing.mixed_documents(df, block_words=16)
    assert out.columns == df.columns
    words = Counter()
    for r in out.collect():
        words[(r.doc_id, r.source)] += len(r.text.split())
        assert r.n_chars == len(r.text) and r.text
    wanted = Counter()
    for r in counts.collect():
        wanted[(r.doc_id, r.source)] += r.taken
    assert +words == +wanted


def test_slots_fill_shards(spark, documents):
    _, _, deal = mixing.mix(documents(corpus(random.Random(7))), block_words=8, shard_slots=50)
    rows = deal.collect()
    places = sorted((r.shard, r.slot) for r in rows)
    assert places == [(i // 50, i % 50) for i in range(len(rows))]
    # Each shard draws from the sources, so shards differ in their counts.
    assert len({tuple(sorted(Counter(r.source_no for r in rows if r.shard == s).items()))
                for s in range(10)}) > 1


def test_empty_and_wordless(spark, documents):
    assert mixing.mix_counts(documents([(1, "a")]).limit(0)).count() == 0
    assert mixing.mixed_documents(documents([(1, "a")]).limit(0)).count() == 0
    got = mixing.mix_counts(documents([(1, None), (2, " ")])).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2


def test_query(spark, tables):
    got = op10_mixing(spark, tables).toPandas()
    assert (got["taken"] <= 3 * got["size"]).all()
    assert abs(got["taken"].sum() - got["size"].sum()) <= 20


def test_columns_of_any_name(spark, documents):
    docs = documents([(i, f"a{i} b c " * 30, "xy"[i % 2]) for i in range(6)]).selectExpr(
        "*", "1 AS spans", "2 AS twin", "3 AS turn", "4 AS `order`", "5 AS joined", "6 AS row")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert {tuple(r)[-6:] for r in out.collect()} == {(1, 2, 3, 4, 5, 6)}


def test_equal_rows_with_other_columns_mix_the_same_again(spark, documents):
    rows = [(7, "a b c d e f g " * 25, "x")] * 4 + [(8, "q r " * 90, "y")]
    docs = documents(rows).withColumn("n_chars", F.monotonically_increasing_id())
    docs = docs.withColumnRenamed("n_chars", "mark")
    mixes = [sorted(map(str, mixing.mixed_documents(d).collect()))
             for d in (docs, docs.orderBy(F.desc("mark")).coalesce(1))]
    assert mixes[0] == mixes[1]


def test_taken_words_by_walking_through_every_slot(spark, documents):
    rng = random.Random(11)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 64, 65, 300]), rng.choice("abcd")) for i in range(150)]
    docs = documents(rows + rows[:9])
    where, _, deal = mixing.mix(docs, block_words=16, shard_slots=32)
    stream = defaultdict(list)  # per source the document of every word
    for r in sorted(where.collect(), key=lambda r: (r["source_no"], r["start"])):
        if r["size"]:
            assert r["start"] == len(stream[r["source_no"]])
            stream[r["source_no"]] += [(r["doc_id"], r["start"])] * r["size"]
    taken, seen = Counter(), set()
    for s in deal.collect():
        assert (s["shard"], s["slot"]) not in seen and s["slot"] < 32
        seen.add((s["shard"], s["slot"]))
        first = s["block"] * 16
        for word in stream[s["source_no"]][first : first + s["words"]]:
            taken[word[0]] += 1
    assert seen == {(i // 32, i % 32) for i in range(len(seen))}
    got = Counter()
    for r in mixing.mix_counts(docs, block_words=16, shard_slots=32).collect():
        got[r["doc_id"]] += r["taken"]
    assert +got == taken
