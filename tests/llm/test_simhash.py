import random

import pytest
from pyspark.sql import functions as F
import xxhash

from textlab.llm import simhash
from textlab.llm.queries import op7_simhash


def slow_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\f\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_groups(fps, tau=2):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= tau:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


def test_fingerprint_by_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "a\tB", "é É ß", "A b c d", "x " * 70_000]
    texts += [" ".join(rng.choices(["Aa", "b", "ÇÉ", "dd,"], k=rng.randint(1, 40)))
              for _ in range(50)]
    for t in texts:
        assert simhash.fingerprint(t) % 2**64 == slow_fingerprint(t)


@pytest.mark.parametrize("hot", [1, 2, 1000])
@pytest.mark.parametrize("tau", [1, 2])
def test_links_have_the_components_of_all_pairs(spark, hot, tau):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(25)] + [0, 2**64 - 1]
    fps = set(base)
    for b in base:
        for _ in range(12):
            fps.add(b ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 4))}))
    fps = sorted(fps)
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), tau=tau, hot=hot).collect()
    where = {f[0]: i for i, f in enumerate(signed)}
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for e in edges:
        i, j = where[e.src], where[e.dst]
        assert bin(fps[i] ^ fps[j]).count("1") <= tau
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    assert [root(i) for i in range(len(fps))] == slow_groups(fps, tau)


def test_query_by_brute_force(spark, tables):
    rows = {r.doc_id: r for r in op7_simhash(spark, tables).collect()}
    docs = sorted(spark.read.parquet(f"{tables}/documents.parquet").collect())
    fps = [slow_fingerprint(d.text) for d in docs]
    assert len(rows) == len(docs)
    for d, fp, g in zip(docs, fps, slow_groups(fps)):
        assert rows[d.doc_id].fingerprint == f"{fp:016x}"
        assert rows[d.doc_id].component_id == docs[g].doc_id


def test_odd_rows(spark, documents):
    df = documents([(5, None), (3, ""), (None, "  "), (9, "a b c d"), (9, "a b c d"),
                    (None, "only here and nowhere else"), (2, "x y")], extra=True)
    got = simhash.simhash_groups(df).collect()
    assert len(got) == 7
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id or -1) for r in got) == [
        (False, 2, 2), (False, 3, 3), (False, 5, 3), (False, 9, 9), (False, 9, 9),
        (True, 0, -1), (True, 0, 3)]
    kept = simhash.one_per_group(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 2, 3, 9]
    assert simhash.simhash_groups(df.limit(0)).count() == 0
    assert simhash.one_per_group(df.limit(0)).count() == 0


def test_a_repeated_id_stands_for_each_of_its_groups(spark, documents):
    one, two, three = ("".join(f"{w}{i} " for i in range(60)) for w in ("alpha", "beta", "gamma"))
    rows = [(5, one), (5, two), (5, two), (7, one), (8, two), (3, three), (5, three)]
    kept = simhash.one_per_group(documents(rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(3, three), (5, one), (5, two)]


def test_the_same_row_stands_for_its_group_in_every_run(spark, documents):
    rows = [(4, "a b c d e"), (4, "a b c d e"), (4, "A b c d e"), (9, "a b c d e")]
    docs = documents(rows).withColumn("n_chars", F.monotonically_increasing_id())
    kept = [list(map(tuple, simhash.one_per_group(d).collect()))
            for d in (docs.coalesce(1), docs.orderBy(F.desc("n_chars")).coalesce(1), docs.repartition(3))]
    assert len(kept[0]) == 1 and kept[0] == kept[1] == kept[2]
