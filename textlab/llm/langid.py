"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of
labelled texts. It reads bytes, labels every position with a distribution over languages,
and the mean over the positions of a text is the text's distribution. Texts are read whole,
as sequences of ``STEPS`` bytes that are run side by side; the state starts anew at each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from textlab.functions.binding import let
from textlab.llm.common import bounded_batches, give_back
from textlab.operators.small import lookup_join
from textlab.sources.storage import materialize

UNDETERMINED = "und"
STEPS = 64
HIDDEN = 8
# The training sample: so many labelled rows, and of each so many windows of ``STEPS`` bytes
# that lie evenly over its whole text.
SAMPLE_ROWS = 2400
SAMPLE_WINDOWS = 32
ROUNDS = 400
BATCH = 192
_SIDE_BY_SIDE = 1024
# Bytes of text cut into rows at a time.
_TOGETHER = 1 << 19
_GATES = ("update", "reset", "new")


@dataclass
class Model:
    """Weights of both directions (``in``: byte to gates, ``rec``: state to gates, ``bias``)
    and of the output layer, and the languages in order."""

    languages: list[str]
    weights: dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def sequences(texts: list[bytes], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut into rows of ``steps`` bytes: bytes (0 behind the end), length of each
    row, and the text it belongs to. An empty text has no row."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    rows = -(-sizes // steps)
    owner = np.repeat(np.arange(len(texts)), rows)
    data = np.zeros(int(rows.sum()) * steps, np.uint8)
    base = np.concatenate(([0], np.cumsum(rows)))[:-1] * steps
    if len(data):
        flat = np.frombuffer(b"".join(texts), np.uint8)
        inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        data[np.repeat(base, sizes) + inside] = flat
    within = np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)
    return data.reshape(-1, steps), np.minimum(sizes[owner] - within * steps, steps), owner


def _run(w: dict[str, np.ndarray], d: str, codes: np.ndarray, live: np.ndarray, keep: list | None):
    """States of one direction for codes of shape (steps, rows); where a row is not live
    the state is carried over. Gates are rows of one matrix, so all work is contiguous."""
    h = w["rec" + d].shape[1]
    state = np.zeros((h, codes.shape[1]), np.float32)
    out = np.empty((len(codes), h, codes.shape[1]), np.float32)
    rec, table, bias = w["rec" + d], w["in" + d] + w["bias" + d][:, None], w["new" + d][:, None]
    order = range(len(codes)) if d == "f" else range(len(codes) - 1, -1, -1)
    full = live.all(axis=1)
    for t in order:
        x = np.take(table, codes[t], axis=1)
        r = rec @ state
        both = _sigmoid(x[: 2 * h] + r[: 2 * h])
        z, reset = both[:h], both[h:]
        inner = r[2 * h :] + bias
        new = np.tanh(x[2 * h :] + reset * inner)
        after = new + z * (state - new)
        if not full[t]:
            after = np.where(live[t], after, state)
        if keep is not None:
            keep.append((t, state, z, reset, inner, new))
        state = after
        out[t] = state
    return out


def position_probabilities(w: dict[str, np.ndarray], codes: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Distribution over languages at every position: (steps, languages, rows)."""
    f, b = _run(w, "f", codes, live, None), _run(w, "b", codes, live, None)
    h = f.shape[1]
    logits = w["out"][:, :h] @ f + w["out"][:, h:] @ b + w["bias"][:, None]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    return logits / logits.sum(axis=1, keepdims=True)


def pooled(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean distribution over the positions of each text; uniform for an empty one."""
    data, size, owner = sequences(texts)
    total = np.zeros((len(texts), len(model.languages)))
    for at in range(0, len(data), _SIDE_BY_SIDE):
        part = slice(at, at + _SIDE_BY_SIDE)
        codes = np.ascontiguousarray(data[part].T)
        live = np.arange(len(codes))[:, None] < size[part][None, :]
        p = position_probabilities(model.weights, codes, live)
        p *= live[:, None, :]
        np.add.at(total, owner[part], p.sum(axis=0).T)
    n = np.fromiter(map(len, texts), np.float64, len(texts))[:, None]
    return np.where(n > 0, total / np.maximum(n, 1), 1 / len(model.languages))


# -- training ---------------------------------------------------------------

def _gradients(w, codes, live, labels):
    """Mean cross-entropy over live positions and its gradients by backpropagation
    through time."""
    kf, kb = [], []
    f, b = _run(w, "f", codes, live, kf), _run(w, "b", codes, live, kb)
    h, n = f.shape[1], live.sum()
    logits = w["out"][:, :h] @ f + w["out"][:, h:] @ b + w["bias"][:, None]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    rows = np.arange(len(labels))
    loss = -(np.log(p[:, labels, rows] + 1e-9) * live).sum() / n
    p[:, labels, rows] -= 1
    p *= live[:, None, :] / n
    g = {"bias": p.sum(axis=(0, 2)),
         "out": np.concatenate([np.einsum("tlr,thr->lh", p, s) for s in (f, b)], axis=1)}
    for d, kept, part in (("f", kf, slice(0, h)), ("b", kb, slice(h, None))):
        rec = w["rec" + d]
        g_rec, g_in = np.zeros_like(rec), np.zeros_like(w["in" + d])
        g_new = np.zeros(h, np.float32)
        carry = np.zeros((h, codes.shape[1]), np.float32)
        from_out = w["out"][:, part].T
        for t, state, z, reset, inner, new in reversed(kept):
            dh = carry + from_out @ p[t]
            on = live[t]
            dz = dh * (state - new) * z * (1 - z)
            dn = dh * (1 - z) * (1 - new * new)
            dr = dn * inner * reset * (1 - reset)
            gates = np.concatenate([dz, dr, dn]) * on
            inner_g = np.concatenate([dz, dr, dn * reset]) * on
            g_rec += inner_g @ state.T
            g_new += inner_g[2 * h :].sum(axis=1)
            one = np.zeros((codes.shape[1], 256), np.float32)
            one[rows, codes[t]] = 1
            g_in += gates @ one
            carry = np.where(on, dh * z + rec.T @ inner_g, carry)
        g |= {"rec" + d: g_rec, "in" + d: g_in, "bias" + d: g_in.sum(axis=1), "new" + d: g_new}
    return loss, g


def _start(languages: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {"out": rng.normal(0, 0.3, (languages, 2 * hidden)), "bias": np.zeros(languages)}
    for d in "fb":
        w |= {"in" + d: rng.normal(0, 0.3, (3 * hidden, 256)),
              "rec" + d: rng.normal(0, hidden**-0.5, (3 * hidden, hidden)),
              "bias" + d: np.repeat([1.0, 0.0, 0.0], hidden), "new" + d: np.zeros(hidden)}
    return {k: v.astype(np.float32) for k, v in w.items()}


def train(
    texts: list[bytes], labels: list[str], hidden: int = HIDDEN, rounds: int = ROUNDS,
    batch: int = BATCH, rate: float = 0.02, seed: int = 5,
) -> Model:
    """Fit the network with Adam on random rows of the texts, each language drawn equally
    often. Without labelled text the model knows no language."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    weights = _start(len(languages), hidden, rng)
    data, size, owner = sequences(texts)
    if not len(data):
        return Model([], weights)
    label = np.array([languages.index(x) for x in labels])[owner]
    pools = [p for p in (np.flatnonzero(label == i) for i in range(len(languages))) if len(p)]
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    for step in range(1, rounds + 1):
        rows = np.concatenate([rng.choice(p, -(-batch // len(pools))) for p in pools])
        codes = np.ascontiguousarray(data[rows].T)
        live = np.arange(len(codes))[:, None] < size[rows][None, :]
        _, g = _gradients(weights, codes, live, label[rows])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        pace = rate * min(1.0, 2.0 * (1 - step / (rounds + 1)))
        for k, x in g.items():
            x = x / max(1.0, norm)
            first[k] = 0.9 * first[k] + 0.1 * x
            second[k] = 0.99 * second[k] + 0.01 * x * x
            fix = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            weights[k] = (weights[k] - pace * fix).astype(np.float32)
    return Model(languages, weights)


# -- over documents ---------------------------------------------------------

def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text divides by 5. A row with
    a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def windows_of(text: Column, n: int, size: int = STEPS) -> Column:
    """At most ``n`` windows of ``size`` bytes, evenly over the whole text; a text with less
    than ``n`` windows is cut into them without a gap."""
    def spread(raw: Column) -> Column:
        rest = F.octet_length(raw) - size
        count = F.least(F.lit(n), F.ceil(F.octet_length(raw) / size).cast("int"))
        step = F.greatest(rest, F.lit(0)) / F.greatest(count - 1, F.lit(1))
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(
            raw, F.floor(i * step).cast("int") + 1, F.lit(size)))

    raw = F.encode(text, "UTF-8")
    return F.when(F.octet_length(raw) > 0, let(raw, spread)).otherwise(F.array().cast("array<binary>"))


def learn(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
    rows: int = SAMPLE_ROWS, windows: int = SAMPLE_WINDOWS, **options,
) -> Model:
    """Fit on about ``rows`` labelled rows that are not held out, taken by a hash of the id:
    the same number of every language where there are enough, one at least. Of a row,
    ``windows`` windows spread over the whole text are learned from. Training alone is
    bounded in this way."""
    known = docs.where(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"),
        (F.pmod(F.xxhash64(F.lit(11), doc_id), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("place"))
    counts = materialize(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    n = counts.count()
    if not n:
        return train([], [], **options)
    each = max(1, rows // n)
    # Of every language the range of the hash that holds about twice the wanted rows, so
    # that few rows are ranked whatever the size of the table.
    share = F.least(F.lit(1.0), F.lit(2.0 * each + 50) / F.col("n"))
    near = lookup_join(known, counts.select("lang", share.alias("share")), "lang").where("place < share")
    first = Window.partitionBy("lang").orderBy("place", F.xxhash64("text"))
    picked = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= each).select(
        "lang", "place", F.explode(windows_of(F.col("text"), windows)).alias("w"))
    sample = sorted((r["lang"], r["place"], bytes(r["w"])) for r in picked.collect())
    return train([w for _, _, w in sample], [name for name, _, _ in sample], **options)


RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def _probabilities(model: Model, raw: list[bytes]) -> np.ndarray:
    """Distribution of every text, some texts at a time."""
    rows, at = [np.zeros((0, len(model.languages)))], 0
    while at < len(raw):
        to, size = at, 0
        while to < len(raw) and (to == at or size < _TOGETHER):
            size += len(raw[to])
            to += 1
        rows.append(pooled(model, raw[at:to]))
        at = to
    return np.concatenate(rows)


def predictor(model: Model):
    """A Pandas UDF from a text column to ``lang_pred, score``."""

    @F.pandas_udf(RESULT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            for texts in batches:
                p = _probabilities(model, [(t or "").encode() for t in texts])
                best = p.argmax(axis=1)
                yield pd.DataFrame({"lang_pred": [model.languages[i] for i in best],
                                    "score": p[np.arange(len(p)), best]})
        finally:
            give_back()

    return predict


def predict_languages(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the mean probability of that language over
    all bytes of the text. A null text, or one without a letter, gets ``und`` and score 0,
    as does every text if the model knows no language. Columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    bounded_batches(docs.sparkSession)
    if not model.languages:
        return docs.withColumn("lang_pred", F.lit(UNDETERMINED)).withColumn("score", F.lit(0.0))
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    # The row in one piece, so that no column of it can meet the prediction.
    out = docs.select(F.struct(*docs.columns).alias("row"), has_letter.alias("letters"),
                      predictor(model)(F.coalesce(F.col(text), F.lit(""))).alias("p"))
    return out.select(
        "row.*", F.when(F.col("letters"), F.col("p.lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(F.col("letters"), F.col("p.score")).otherwise(0.0).alias("score"))
