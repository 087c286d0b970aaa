"""Vectors, scoring, metrics and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.registry import query
from textlab.functions import scoring
from textlab.operators import embed, metrics
from textlab.plans.evaluate import evaluate

# A given ReLU head: 64 inputs, a reduction to 16, 8 hidden units, outputs as needed.
def _weights(outs: int, ins: int) -> list[list[float]]:
    return [[((i * 31 + j * 17) % 23 - 11) / 16 for j in range(ins)] for i in range(outs)]


def _bias(outs: int) -> list[float]:
    return [(i % 5 - 2) / 8 for i in range(outs)]


def head(*sizes: int) -> list[scoring.Layer]:
    return [scoring.Layer.of(_weights(o, i), _bias(o)) for i, o in zip(sizes, sizes[1:])]


def _matrix(layer: scoring.Layer) -> str:
    rows = [f"{{w: {list(w)}::DOUBLE[], b: {b}::DOUBLE}}" for w, b in zip(layer.weights, layer.bias)]
    return f"[{', '.join(rows)}]"


def head_sql(layers: list[scoring.Layer]) -> str:
    """CTE chain ``h0, h1, ..`` ending in the logits of every vector."""
    steps = ["h0 AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"]
    for i, layer in enumerate(layers):
        unit = "list_dot_product(u.w, x) + u.b"
        if i < len(layers) - 1:
            unit = f"greatest({unit}, 0.0)"
        steps.append(
            f"h{i + 1} AS (SELECT vec_id, label, [{unit} for u in {_matrix(layer)}] AS x FROM h{i})"
        )
    return ",\n".join(steps)


def unrolled_sql(source: str, key: str, vector: str, ctes: str) -> str:
    return f"""WITH {ctes},
spread AS (SELECT {key}, unnest({vector}) AS value, generate_subscripts({vector}, 1) - 1 AS dim FROM {source})
SELECT {key}, CAST(dim AS INTEGER) AS dim, round(CAST(value AS DOUBLE), 6) + 0.0 AS value FROM spread"""


# -- text to vectors --------------------------------------------------------

@query("embed_hashing", f"""WITH {V.TWEETS_CTE},
words AS (SELECT row_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM tweets),
slots AS (SELECT row_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS dim FROM words),
counts AS (SELECT row_id, dim, count(*) AS n FROM slots GROUP BY row_id, dim),
norms AS (SELECT row_id, sqrt(sum(CAST(n * n AS DOUBLE))) AS norm FROM counts GROUP BY row_id),
cells AS (SELECT row_id, unnest(range(64)) AS dim FROM tweets)
SELECT c.row_id, CAST(c.dim AS INTEGER) AS dim,
  round(CAST(CAST(coalesce(k.n / m.norm, 0) AS FLOAT) AS DOUBLE), 6) + 0.0 AS value
FROM cells c LEFT JOIN counts k ON c.row_id = k.row_id AND c.dim = k.dim
LEFT JOIN norms m ON c.row_id = m.row_id""")
def embed_hashing(spark, sf):
    tasks = spark.sparkContext.defaultParallelism
    return V.unrolled(embed.embed(V.tweets(spark, sf), partitions=tasks), "row_id")


@query("embed_encoder", f"""WITH {V.TWEETS_CTE}
SELECT row_id, CAST(length(text) AS DOUBLE) AS chars,
  CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS spaces FROM tweets""")
def embed_encoder(spark, sf):
    """A user-supplied encoder run in batches inside the tasks."""
    def factory():
        return lambda texts: [(len(t), t.count(" ")) for t in texts]

    tasks = spark.sparkContext.defaultParallelism
    vectors = embed.embed(V.tweets(spark, sf), factory, batch_size=16, partitions=tasks)
    return vectors.select(
        "row_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("chars", "spaces"))]
    )


@query("embedding_profile", """SELECT count(*) AS n_rows, CAST(max(len(embedding)) AS INTEGER) AS width
FROM embeddings""")
def embedding_profile(spark, sf):
    return embed.embedding_profile(V.embeddings(spark, sf))


@query("pool_first", unrolled_sql("first", "doc_id", "embedding",
       f"{V.TOKENS_CTE}, first AS (SELECT doc_id, embedding FROM tokens WHERE token = 0)"))
def pool_first(spark, sf):
    return V.unrolled(embed.pool_first(V.tokens(spark, sf)), "doc_id")


@query("pool_first_array", unrolled_sql("embeddings", "vec_id", "embedding",
       "self AS (SELECT 1)"))
def pool_first_array(spark, sf):
    """The first of an array of token vectors: the vector itself before its reverse."""
    tokens = F.array("embedding", F.reverse("embedding"))
    return V.unrolled(
        V.embeddings(spark, sf).select("vec_id", scoring.pool_first(tokens).alias("embedding")),
        "vec_id",
    )


def _mean_sql(where: str) -> str:
    return f"""WITH {V.TOKENS_CTE},
cells AS (SELECT doc_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim
  FROM tokens {where})
SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(avg(CAST(v AS DOUBLE)), 6) + 0.0 AS value
FROM cells GROUP BY doc_id, dim"""


@query("pool_mean", _mean_sql(""))
def pool_mean(spark, sf):
    return V.unrolled(embed.pool_mean(V.tokens(spark, sf)), "doc_id")


@query("pool_mean_last_layers", _mean_sql("WHERE layer > (SELECT max(layer) FROM tokens) - 4"))
def pool_mean_last_layers(spark, sf):
    return V.unrolled(embed.pool_mean(V.tokens(spark, sf), layer="layer"), "doc_id")


@query("truncate_vector", unrolled_sql("cut", "vec_id", "x",
       "cut AS (SELECT vec_id, [trunc(CAST(v AS DOUBLE) * 10) for v in embedding] AS x FROM embeddings)"))
def truncate_vector(spark, sf):
    scaled = F.transform("embedding", lambda v: v.cast("double") * 10.0)
    return V.unrolled(
        V.embeddings(spark, sf).select("vec_id", scoring.truncate_vector(scaled).alias("embedding")),
        "vec_id",
    )


# -- heads and decisions ----------------------------------------------------

@query("score_head", f"""WITH {head_sql(head(64, 8, 1))}
SELECT vec_id, round(x[1], 6) + 0.0 AS z FROM h2""")
def score_head(spark, sf):
    logits = scoring.score_head("embedding", head(64, 8, 1), engine="native")
    return V.embeddings(spark, sf).select("vec_id", V.r6(F.get(logits, F.lit(0))).alias("z"))


@query("score_head_reduced", f"""WITH {head_sql(head(64, 16, 8, 1))}
SELECT vec_id, round(x[1], 6) + 0.0 AS z FROM h3""")
def score_head_reduced(spark, sf):
    logits = scoring.score_head("embedding", head(64, 16, 8, 1), engine="arrow")
    return V.embeddings(spark, sf).select("vec_id", V.r6(F.get(logits, F.lit(0))).alias("z"))


@query("predict_head_binary", f"""WITH {head_sql(head(64, 8, 1))}
SELECT vec_id, label % 2 AS label, CAST(x[1] > 0 AS INTEGER) AS pred,
  round(1.0 / (1.0 + exp(-x[1])), 6) AS probability FROM h2""")
def predict_head_binary(spark, sf):
    logits = V.embeddings(spark, sf).withColumn("z", scoring.score_head("embedding", head(64, 8, 1)))
    z = F.get("z", F.lit(0))
    return logits.select(
        "vec_id", (F.col("label") % 2).alias("label"), scoring.predict_binary(z).alias("pred"),
        V.r6(scoring.sigmoid_col(z)).alias("probability"),
    )


@query("predict_head_multiclass", f"""WITH {head_sql(head(64, 8, 4))}
SELECT vec_id, label % 4 AS label, CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS pred FROM h2""")
def predict_head_multiclass(spark, sf):
    logits = V.embeddings(spark, sf).withColumn("x", scoring.score_head("embedding", head(64, 8, 4)))
    return logits.select(
        "vec_id", (F.col("label") % 4).alias("label"), scoring.predict_multiclass("x").alias("pred")
    )


@query("predict_binary", f"""WITH {V.PREDICTIONS_CTE}
SELECT row_id, z, CAST(z > 0 AS INTEGER) AS decision FROM predictions""")
def predict_binary(spark, sf):
    return V.predictions(spark, sf).select("row_id", "z", scoring.predict_binary("z").alias("decision"))


@query("predict_multiclass", f"""WITH {V.PREDICTIONS4_CTE}
SELECT row_id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS decision FROM predictions4""")
def predict_multiclass(spark, sf):
    return V.predictions4(spark, sf).select(
        "row_id", scoring.predict_multiclass("logits").alias("decision")
    )


@query("sigmoid", f"""WITH {V.PREDICTIONS_CTE}
SELECT row_id, round(1.0 / (1.0 + exp(-z)), 6) AS p FROM predictions""")
def sigmoid(spark, sf):
    return V.predictions(spark, sf).select("row_id", V.r6(scoring.sigmoid_col("z")).alias("p"))


@query("softmax", f"""WITH {V.PREDICTIONS4_CTE},
e AS (SELECT row_id, [exp(v - list_max(logits)) for v in logits] AS x FROM predictions4),
p AS (SELECT row_id, [v / list_sum(x) for v in x] AS p FROM e)
SELECT row_id, CAST(unnest(range(4)) AS INTEGER) AS dim, round(unnest(p), 6) AS value FROM p""")
def softmax(spark, sf):
    rows = V.predictions4(spark, sf).select("row_id", scoring.softmax_col("logits").alias("embedding"))
    return V.unrolled(rows, "row_id")


# -- metrics ----------------------------------------------------------------

@query("pair_predictions", """SELECT doc_id AS row_id, quality AS label, 1 - toxic AS pred FROM labels""")
def pair_predictions(spark, sf):
    labels = V.table(spark, sf, "labels")
    targets = labels.select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"))
    predicted = labels.select(F.col("doc_id").alias("row_id"), (1 - F.col("toxic")).alias("pred"))
    return metrics.pair_predictions(targets, predicted)


WEIGHTS_SQL = """counts AS (SELECT label, count(*) AS n FROM {source} GROUP BY label),
weights AS (SELECT label, n, (1.0::DOUBLE / n) / (SELECT sum(1.0::DOUBLE / n) FROM counts) AS weight FROM counts)"""


@query("class_weights", f"""WITH {V.PREDICTIONS4_CTE}, {WEIGHTS_SQL.format(source='predictions4')}
SELECT label, n, round(weight, 6) AS weight FROM weights""")
def class_weights(spark, sf):
    weights = metrics.class_weights(V.predictions4(spark, sf))
    return weights.withColumn("weight", V.r6("weight"))


@query("accuracy", f"""WITH {V.PREDICTIONS_CTE}
SELECT round(avg(CAST(label = pred AS INTEGER)), 6) AS accuracy FROM predictions""")
def accuracy(spark, sf):
    return metrics.accuracy(V.predictions(spark, sf)).select(V.r6("accuracy").alias("accuracy"))


@query("confusion", f"""WITH {V.PREDICTIONS4_CTE}
SELECT label, pred, count(*) AS n FROM predictions4 GROUP BY label, pred""")
def confusion(spark, sf):
    return metrics.confusion(V.predictions4(spark, sf))


CELLS_SQL = f"""{V.PREDICTIONS_CTE}, cells AS (SELECT
  count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label <> 1 AND pred = 1) AS fp,
  count(*) FILTER (label = 1 AND pred <> 1) AS fn, count(*) FILTER (label <> 1 AND pred <> 1) AS tn
  FROM predictions)"""
RATIO = "round(coalesce({a}::DOUBLE / nullif({b}, 0), 0), 6)"


@query("binary_scores", f"""WITH {CELLS_SQL} SELECT tp, fp, fn, tn,
  {RATIO.format(a='(tp + tn)', b='tp + fp + fn + tn')} AS accuracy,
  {RATIO.format(a='tp', b='tp + fp')} AS precision, {RATIO.format(a='tp', b='tp + fn')} AS recall,
  {RATIO.format(a='(2 * tp)', b='2 * tp + fp + fn')} AS f1 FROM cells""")
def binary_scores(spark, sf):
    return metrics.binary_scores(V.predictions(spark, sf)).withColumns(
        {c: V.r6(c) for c in ("accuracy", "precision", "recall", "f1")}
    )


CLASSES_SQL = f"""{V.PREDICTIONS4_CTE},
sides AS (SELECT label AS class, 1 AS support, 0 AS predicted, CAST(label = pred AS INTEGER) AS hits FROM predictions4
  UNION ALL SELECT pred, 0, 1, 0 FROM predictions4),
sums AS (SELECT class, CAST(sum(support) AS BIGINT) AS support, CAST(sum(predicted) AS BIGINT) AS predicted,
  CAST(sum(hits) AS BIGINT) AS hits FROM sides GROUP BY class),
pr AS (SELECT *, coalesce(hits::DOUBLE / nullif(predicted, 0), 0) AS p,
  coalesce(hits::DOUBLE / nullif(support, 0), 0) AS r FROM sums),
classes AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM pr)"""


@query("weighted_f1", f"""WITH {CLASSES_SQL}
SELECT round(sum(f * support) / sum(support), 6) AS f1 FROM classes""")
def weighted_f1(spark, sf):
    return metrics.weighted_f1(V.predictions4(spark, sf)).select(V.r6("f1").alias("f1"))


@query("classification_report", f"""WITH {CLASSES_SQL}
SELECT CAST(class AS VARCHAR) AS class, round(p, 6) AS precision, round(r, 6) AS recall,
  round(f, 6) AS f1, support FROM classes
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits)::DOUBLE / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM classes
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6),
  CAST(sum(support) AS BIGINT) FROM classes
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6),
  round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM classes""")
def classification_report(spark, sf):
    return metrics.classification_report(V.predictions4(spark, sf)).withColumns(
        {c: V.r6(c) for c in ("precision", "recall", "f1")}
    )


# -- losses -----------------------------------------------------------------

BCE = "greatest(z, 0) - z * label + ln(1 + exp(-abs(z)))"


@query("bce_loss", f"WITH {V.PREDICTIONS_CTE} SELECT round(avg({BCE}), 6) AS loss FROM predictions")
def bce_loss(spark, sf):
    return metrics.bce_loss(V.predictions(spark, sf)).select(V.r6("loss").alias("loss"))


NLL = "ln(list_sum([exp(v) for v in logits])) - logits[p.label + 1]"
CE_CTE = f"""{V.PREDICTIONS4_CTE}, {WEIGHTS_SQL.format(source='predictions4')},
terms AS (SELECT p.label, p.pred, w.weight, {NLL} AS nll FROM predictions4 p JOIN weights w ON p.label = w.label)"""


@query("weighted_ce_loss", f"""WITH {CE_CTE}
SELECT round(sum(weight * nll) / sum(weight), 6) AS loss FROM terms""")
def weighted_ce_loss(spark, sf):
    rows = V.predictions4(spark, sf)
    loss = metrics.weighted_ce_loss(rows, metrics.class_weights(rows))
    return loss.select(V.r6("loss").alias("loss"))


@query("epoch_loss", f"WITH {V.PREDICTIONS_CTE} SELECT round(avg({BCE}), 6) AS loss FROM predictions")
def epoch_loss(spark, sf):
    term = scoring.bce_term("z", "label")
    return metrics.epoch_loss(V.predictions(spark, sf), term).select(V.r6("loss").alias("loss"))


@query("epoch_loss_compat", f"""WITH {V.PREDICTIONS_CTE},
b AS (SELECT batch_id, avg({BCE}) AS m, count(*) AS n FROM predictions GROUP BY batch_id)
SELECT round(sum(m) / sum(n), 6) AS loss FROM b""")
def epoch_loss_compat(spark, sf):
    term = scoring.bce_term("z", "label")
    return metrics.epoch_loss(V.predictions(spark, sf), term, compat=True).select(
        V.r6("loss").alias("loss")
    )


@query("l1_penalty", """SELECT round(0.001::DOUBLE * sum(list_sum(
[abs(CAST(v AS DOUBLE)) for v in embedding])), 6) AS penalty
FROM embeddings WHERE label <> 0""")
def l1_penalty(spark, sf):
    weights = V.embeddings(spark, sf).select(
        F.col("embedding").alias("w"), (F.col("label") == 0).alias("is_bias")
    )
    return metrics.l1_penalty(weights, 0.001).select(V.r6("penalty").alias("penalty"))


@query("evaluate_binary", f"""WITH {CELLS_SQL}
SELECT (SELECT round(avg({BCE}), 6) FROM predictions) AS loss,
  {RATIO.format(a='(tp + tn)', b='tp + fp + fn + tn')} AS accuracy,
  {RATIO.format(a='(2 * tp)', b='2 * tp + fp + fn')} AS f1 FROM cells""")
def evaluate_binary(spark, sf):
    row = evaluate(V.predictions(spark, sf))
    return row.select(*[V.r6(c).alias(c) for c in row.columns])


@query("evaluate_multiclass", f"""WITH {CE_CTE}, {CLASSES_SQL[len(V.PREDICTIONS4_CTE) + 2:]}
SELECT (SELECT round(sum(weight * nll) / sum(weight), 6) FROM terms) AS loss,
  round(sum(hits)::DOUBLE / sum(support), 6) AS accuracy,
  round(sum(f * support) / sum(support), 6) AS f1 FROM classes""")
def evaluate_multiclass(spark, sf):
    rows = V.predictions4(spark, sf)
    row = evaluate(rows, multiclass=True, weights=metrics.class_weights(rows))
    return row.select(*[V.r6(c).alias(c) for c in row.columns])
