import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.operators import epochs as E
from textlab.operators import metric_store as M
from textlab.operators import vector_store as S
from textlab.operators.metrics import class_weights, classification_report
from textlab.plans.evaluate import evaluate
from textlab.sources.delimited import LABELLED_SCHEMA
from textlab.streaming.sweep import sweep_files, swept


# -- vectors by content -----------------------------------------------------

def counting(folder, fail_at=None):
    """An encoder that notes every text it gets in a file of its own."""
    def factory():
        import os
        import uuid

        def encode(texts):
            for t in texts:
                if t == fail_at:
                    raise RuntimeError("encoder lost")
                with open(os.path.join(folder, uuid.uuid4().hex), "w", encoding="utf-8") as f:
                    f.write(t)
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    return factory


def noted(folder):
    return sorted(p.read_text(encoding="utf-8") for p in folder.iterdir())


def test_each_text_is_encoded_once(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    log.mkdir()
    rows = [(i, t) for i, t in enumerate(["a", "bb", "a", None, "", "bb", "ccc", "a"] * 5)]
    df = spark.createDataFrame(rows, "row_id long, text string").repartition(4)
    out = S.embed_stored(df, store, "len", counting(str(log)), slices=3)
    assert out.columns == ["row_id", "text", "embedding"]
    got = {r["row_id"]: r["embedding"] for r in out.collect()}
    assert got == {i: None if t is None else [float(len(t)), 1.0] for i, t in rows}
    assert noted(log) == ["", "a", "bb", "ccc"]
    more = df.unionByName(spark.createDataFrame([(99, "dddd"), (98, "a")], df.schema))
    assert S.update_store(more, store, "len", counting(str(log)), slices=3) == 1
    assert S.update_store(more, store, "len", counting(str(log)), slices=3) == 0
    assert noted(log) == ["", "a", "bb", "ccc", "dddd"]
    assert S.stored_vectors(spark, store, "other").count() == 0
    assert S.update_store(df.limit(0), store, "none") == 0
    with pytest.raises(ValueError):
        S.update_store(df, store, "a/b")


def test_finished_slices_survive(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    log.mkdir()
    texts = [f"text {i}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    place = df.select("text", F.pmod(F.xxhash64(S.text_digest("text")), F.lit(4)).alias("s")).collect()
    last = next(r["text"] for r in place if r["s"] == 3)
    with pytest.raises(Exception, match="encoder lost"):
        S.update_store(df, store, "len", counting(str(log), last), slices=4)
    done = S.stored_vectors(spark, store, "len").count()
    assert done == sum(r["s"] < 3 for r in place)
    assert S.update_store(df, store, "len", counting(str(log)), slices=4) == 40 - done
    assert S.stored_vectors(spark, store, "len").count() == 40


# -- metrics by part --------------------------------------------------------

def scored(spark, n, classes):
    rng = np.random.default_rng(n)
    rows = [(i, int(rng.integers(classes)), [float(x) for x in rng.normal(size=classes)]) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, label int, logits array<double>")
    df = df.withColumn("z", F.col("logits")[0])
    top = (F.array_position("logits", F.array_max("logits")) - 1).cast("int")
    return df.withColumn("pred", (F.col("z") > 0).cast("int") if classes == 2 else top)


@pytest.mark.parametrize("classes", [2, 4])
def test_merged_parts_are_the_evaluation_of_all(spark, tmp_path, classes):
    df, path, multi = scored(spark, 200, classes), str(tmp_path / "m"), classes > 2
    weights = class_weights(df) if multi else None
    for run, low in (("a", 0), ("b", 100)):
        for part in range(3):
            rows = df.where(f"row_id >= {low} AND row_id % 3 = {part}")
            M.store_part(M.metric_part(rows, multi, weights=weights), path, run, f"day{part}")
    M.store_part(M.metric_part(df.limit(0), multi, weights=weights), path, "a", "empty")
    got = {r["run"]: r for r in M.merged_metrics(spark, path, multi).collect()}
    for run, low in (("a", 0), ("b", 100)):
        want = evaluate(df.where(f"row_id >= {low}"), multi, weights=weights).first()
        assert [got[run][c] for c in ("loss", "accuracy", "f1")] == pytest.approx(list(want))
        report = sorted(map(tuple, M.merged_report(spark, path, run).collect()))
        assert str(report) == str(sorted(map(tuple, classification_report(df.where(f"row_id >= {low}")).collect())))
    # A part that is stored again replaces what it said before.
    M.store_part(M.metric_part(df.where("row_id >= 100 AND row_id % 3 = 0"), multi, weights=weights), path, "a", "day0")
    assert M.merged_cells(spark, path).where("run = 'a'").agg(F.sum("n")).first()[0] == 200 - 34
    with pytest.raises(ValueError):
        M.store_part(df, path, "a=b", "x")


# -- epochs -----------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 1000, 1001])
def test_a_permutation_per_epoch(spark, n):
    ranks = spark.range(n).withColumnRenamed("id", "rank")
    orders = []
    for epoch in (0, 1):
        place = ranks.select("rank", E.place_of(F.col("rank"), n, 7, epoch).alias("p")).collect()
        order = [r["p"] for r in sorted(place)]
        assert sorted(order) == list(range(n))
        back = E.ranks_at(np.array(order), n, 7, epoch)
        assert back.tolist() == list(range(n))
        orders.append(order)
    if n >= 64:
        assert orders[0] != orders[1]
        moved = np.abs(np.array(orders[0]) - np.arange(n)).mean() / n
        assert 0.25 < moved < 0.42  # a third for a random order
        assert abs(np.corrcoef(orders[0], orders[1])[0, 1]) < 0.3


def test_batches_of_later_epochs_exchange_nothing(spark, monkeypatch):
    df = spark.range(1000).selectExpr("id AS row_id", "id % 3 AS label")
    ranked = E.store_ranks(df, seed=3)
    batches = E.epoch_batches(ranked, 64, 5)
    plan = batches._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    by_batch = {b: sorted(r["row_id"] for r in batches.where(F.col("batch_id") == b).collect()) for b in range(16)}
    assert [len(by_batch[b]) for b in range(16)] == [64] * 15 + [40]
    for listed in (E.LISTED, 10):
        monkeypatch.setattr(E, "LISTED", listed)
        alone = E.epoch_batch(ranked, 64, 15, 5)
        assert sorted(r["row_id"] for r in alone.collect()) == by_batch[15]
    assert E.epoch_batch(ranked, 64, 16, 5).count() == 0
    with pytest.raises(ValueError):
        E.epoch_batches(ranked, 0)


# -- sweeps -----------------------------------------------------------------

def test_sweep_takes_files_once_and_sets_bad_records_aside(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    (inbox / "deep").mkdir(parents=True)
    head = "row_id,Tweet text,Label\n"
    (inbox / "a.csv").write_text(head + '1,"see @someone ""now""",0\n2,two,not-a-number\n')
    (inbox / "deep" / "b.csv").write_text(head + '3,"line\nbreak",1\n')

    def sweep():
        query = sweep_files(spark, str(inbox), out, state, LABELLED_SCHEMA, max_files=1)
        query.awaitTermination()
        return {r["row_id"]: r["Tweet text"] for r in swept(spark, out).collect()}

    assert sweep() == {1: 'see <USER> "now"', 3: "line\nbreak"}
    assert sweep() == {1: 'see <USER> "now"', 3: "line\nbreak"}
    (inbox / "c.csv").write_text(head + "4,four,1\n")
    assert set(sweep()) == {1, 3, 4}
    assert swept(spark, out).count() == 3
    bad = swept(spark, out, "quarantine").collect()
    assert [r["record"] for r in bad] == ["2,two,not-a-number"]
    counts = {r["file"].rsplit("/", 1)[1]: (r["rows"], r["bad"]) for r in swept(spark, out, "manifest").collect()}
    assert counts == {"a.csv": (1, 1), "b.csv": (1, 0), "c.csv": (1, 0)}
    with pytest.raises(ValueError):
        swept(spark, out, "other")
