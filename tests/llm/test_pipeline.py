import random
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_simhash import slow_fingerprint, slow_groups
from textlab.llm import langid, mixing, simhash, substring
from textlab.sources.storage import materialize


def test_stages_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "simhash_dedup", "substring_dedup", "source_mixing", "bpe_encoding"]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, tables), name)
        seen[name] = (before, docs)
        if name != "bpe_encoding":
            assert docs.columns == columns
    before, after = seen["language_id"]
    judged = langid.predict_languages(before, langid.learn(before)).where(
        f"lang_pred <> 'und' AND score >= {corpus_pipeline.MIN_SCORE}")
    assert after.count() == judged.count() > 0.98 * before.count()
    before, after = seen["simhash_dedup"]
    groups = simhash.simhash_groups(before).select("component_id").distinct().count()
    assert after.count() == groups < before.count()
    before, after = seen["substring_dedup"]
    assert after.count() == before.count()
    assert substring.remove_repeats(before).where("n_removed > 0").count() > 0
    before, after = seen["source_mixing"]
    n = lambda df: df.selectExpr("sum(size(filter(split(text, '[ \\t-\\r]+'), w -> w <> '')))").first()[0]
    assert abs(n(before) - n(after)) <= 20
    last = seen["bpe_encoding"][1]
    assert last.where("NOT round_trip").count() == 0 and last.count() == after.count()


def test_empty_documents(spark, documents):
    docs = documents([(1, "a")]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_language_bar_follows_the_number_of_languages(spark, documents, monkeypatch):
    assert corpus_pipeline.least_score(4) == corpus_pipeline.MIN_SCORE
    assert corpus_pipeline.least_score(1) == 0 and corpus_pipeline.least_score(40) < 0.05
    assert 0.5 < corpus_pipeline.least_score(2) < 1
    docs = documents([(1, "some words"), (2, "123"), (3, None)]).selectExpr(
        "doc_id", "text", "CAST(NULL AS string) AS lang", "source", "n_chars")
    assert [r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()] == [1]
    # Two languages and a score between the old bar and the new one.
    two = documents([(1, "some words")])
    monkeypatch.setattr(langid, "learn", lambda docs: type("Model", (), {"languages": ["en", "de"]})())
    monkeypatch.setattr(langid, "predict_languages", lambda docs, model: docs.selectExpr(
        "*", "'en' AS lang_pred", "0.52D AS score"))
    assert corpus_pipeline.identify_language(spark, two, "").count() == 0


def slow_pipeline(docs, model):
    """All stages on a list of (doc_id, text, lang, source) rows with unique ids: languages by
    the network's pooled probabilities, groups and windows by comparing all with all."""
    bar = corpus_pipeline.least_score(len(model.languages))
    kept = [d for d in docs if d[1] and any(c.isalpha() for c in d[1])
            and langid.pooled(model, [d[1].encode()])[0].max() >= bar]
    kept.sort()
    groups = slow_groups([slow_fingerprint(d[1]) for d in kept])
    kept = [d for i, d in enumerate(kept) if groups[i] == i]
    words = [d[1].split() for d in kept]
    windows = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for d, w in zip(kept, words):
        gone = {p for i in range(len(w) - 34) if windows[tuple(w[i : i + 35])] > 1 for p in range(i, i + 35)}
        out.append((d[0], " ".join(x for i, x in enumerate(w) if i not in gone) if gone else d[1]))
    return out


def test_by_brute_force(spark, documents, parquet_dir):
    rng = random.Random(4)
    passage = " ".join(f"shared{i}" for i in range(50))
    texts = [" ".join(rng.choice(["some", "plain", "words", "of", "text", f"n{rng.randrange(99)}"])
                      for _ in range(rng.randint(20, 90))) for _ in range(40)]
    texts += [texts[3], texts[3] + "  ", texts[5].upper(), f"{texts[7]} {passage} end", f"start {passage} {texts[9]}",
              "12 34 ! ?", "", None, "x " * 3000]
    rows = [(i, t, "abc"[i % 3]) for i, t in enumerate(texts)]
    docs = documents(rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("xx"))
    docs.write.parquet(f"{parquet_dir}/documents.parquet")
    model = langid.learn(spark.read.parquet(f"{parquet_dir}/documents.parquet"))
    want = dict(slow_pipeline([(i, t, "", s) for i, t, s in rows], model))
    assert len(want) < len(texts) - 5 and any("shared0" not in t and texts[i] and "shared0" in texts[i]
                                              for i, t in want.items())
    got = corpus_pipeline.run(spark, parquet_dir)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    taken = Counter()
    for r in got.collect():
        assert r["round_trip"] and r["n_tokens"] == len(r["ids"])
        text = library.decode(r["ids"], skip_special_tokens=False)
        assert r["ids"] == library.encode(text, add_special_tokens=False).ids
        # Words of the document in its order, in part or whole.
        words, at = want[r["doc_id"]].split(), 0
        for w in text.split():
            at = words.index(w, at) + 1
        taken[r["doc_id"]] += len(text.split())
    left = documents([(i, t, "abc"[i % 3]) for i, t in want.items()])
    counts = {r["doc_id"]: r["taken"] for r in mixing.mix_counts(left).collect()}
    assert +taken == Counter({i: n for i, n in counts.items() if n})


def test_odd_documents(spark, parquet_dir):
    schema = ("doc_id long, text string, lang string, source string, n_chars long, fp int, spans string, _p int, "
              "component_id long")
    good = [(i, f"some words of document number {i} " * 9, "en", "a", 9, 1, "x", 2, 3) for i in range(30)]
    odd = [(None, "no id at all but some words", "en", None, None, None, None, None, None),
           (1, None, None, None, None, None, None, None, None), (2, "", "en", "a", 0, 1, "y", 2, 3),
           (50, "long " * 60_000, None, "b", 1, 1, "x", 2, 3), good[0], good[0],
           (51, "<|endoftext|> " * 40, "de", "b", 1, 1, "x", 2, 3), (52, "\x00   ́ 😀 letters", "de", "b", 1, 1, "x", 2, 3)]
    docs = spark.createDataFrame(good + odd, schema)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, parquet_dir), name)
        if name != "bpe_encoding":
            assert docs.columns == columns
    assert docs.where("NOT round_trip").count() == 0 and docs.count() > 0
