"""First-order training of heads on a stored table: one distributed pass per step.

A pass reads the training table once. Every task adds up loss, confusion cells and
gradients of its rows, in Arrow batches, and returns one row; these rows are added in a
tree, in the order of the tasks, and the driver makes one optimiser step and sends the new
weights with the next pass. No task and no driver ever holds the table.

Several heads are trained side by side (``Member``): a pass serves all of them, each with
its own settings and its own fold left out for validation. So k folds cost as many passes
as one session, and so do the trials of a search.

What a member knows after an epoch (weights, moments, rate, lives, log) can be stored as a
row under a path; training started again with that path goes on after the last stored
epoch and ends with the same log.
"""

from __future__ import annotations

import io
import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.functions import head
from textlab.functions.scoring import Layer
from textlab.operators.logs import MIN_LIVES
from textlab.plans.config import Config
from textlab.sources.storage import fresh_path, materialize

# Rows of sums that one task adds up, and that the driver takes at most at a time.
FAN_IN = 64
# The plateau rule and the lower end of the cosine schedule.
PLATEAU_FACTOR, PLATEAU_THRESHOLD, RATE_STEP, LOWEST_RATE = 0.1, 1e-4, 1e-8, 1e-6
STATE_SCHEMA = "member string, state binary, epoch int"


@dataclass(frozen=True)
class Member:
    """One head to train: rows of fold ``holdout`` validate it, all others train it. With
    None it learns from all rows and is measured on them."""

    name: str
    config: Config
    holdout: int | None = None


@dataclass(frozen=True)
class Metrics:
    loss: float
    accuracy: float
    f1: float


@dataclass(frozen=True)
class TrainedHead:
    """Weights of a trained head; ``plans.fit.score`` takes it like a fitted model."""

    layers: tuple[Layer, ...]


@dataclass
class Learner:
    """The state of a member between two steps."""

    member: Member
    layers: head.Layers
    first: head.Layers
    second: head.Layers
    rate: float
    step: int = 0
    epoch: int = 0
    lives: int = 0
    best_f1: float = -1.0
    best_epoch: int = 0
    best_layers: head.Layers | None = None
    plateau_best: float = -math.inf
    plateau_bad: int = 0
    stopped: bool = False
    failed: bool = False
    log: list[tuple] = field(default_factory=list)  # epoch, loss, accuracy, f1, rate, train loss

    @staticmethod
    def new(member: Member, layers: head.Layers) -> Learner:
        zero = [(np.zeros_like(w), np.zeros_like(b)) for w, b in layers]
        return Learner(member, layers, zero, [(w.copy(), b.copy()) for w, b in zero], member.config.lr,
                       lives=max(MIN_LIVES, member.config.patience))

    @property
    def live(self) -> bool:
        return not (self.stopped or self.failed) and self.epoch < self.member.config.max_epochs

    def model(self) -> TrainedHead:
        """The best head so far; the last one if it is not validated."""
        best = self.layers if self.member.holdout is None else self.best_layers or self.layers
        return TrainedHead(tuple(Layer.of(w.tolist(), b.tolist()) for w, b in best))

    def learn(self, sums: np.ndarray) -> float:
        """One optimiser step from the sums of a batch; returns loss and penalty."""
        c = self.member.config
        weight = sums[1]
        if weight <= 0:
            return 0.0
        gradient = head.gradient_layers(sums[2 + c.classes**2 :] / weight, self.layers)
        gradient, penalty = head.with_penalty(gradient, self.layers, c.l1)
        gradient = head.clipped(gradient)
        self.step += 1
        if c.opt == "SGD":
            self.layers = head.plain_step(self.layers, gradient, self.rate, c.weight_decay)
        else:
            self.layers, self.first, self.second = head.adaptive_step(
                self.layers, gradient, self.first, self.second, self.step, self.rate, c.weight_decay)
        loss = float(sums[0] / weight) + penalty
        self.failed = not (math.isfinite(loss) and all(np.isfinite(w).all() for w, _ in self.layers))
        return loss

    def end_epoch(self, m: Metrics, train_loss: float, stop_early: bool) -> None:
        """Log the epoch, then adapt rate, best head and lives."""
        c = self.member.config
        self.log.append((self.epoch, m.loss, m.accuracy, m.f1, self.rate, train_loss))
        if self.member.holdout is None:
            self._refit_rate(m.loss)
        else:
            self._plateau(m.f1)
            if m.f1 >= self.best_f1:
                self.best_f1, self.best_epoch, self.best_layers = m.f1, self.epoch, self.layers
                self.lives = max(MIN_LIVES, c.patience)
            else:
                self.lives -= 1
                self.stopped = stop_early and self.lives == 0
        self.epoch += 1

    def _plateau(self, score: float) -> None:
        """A tenth of the rate after more than ``patience`` epochs without a better score."""
        better = self.plateau_best * (1 + math.copysign(PLATEAU_THRESHOLD, self.plateau_best))
        if score > better or self.plateau_best == -math.inf:
            self.plateau_best, self.plateau_bad = score, 0
            return
        self.plateau_bad += 1
        if self.plateau_bad > self.member.config.patience:
            lower = self.rate * PLATEAU_FACTOR
            if self.rate - lower > RATE_STEP:
                self.rate = lower
            self.plateau_bad = 0

    def _refit_rate(self, loss: float) -> None:
        """Without validation: half of a cosine, then the plateau rule on the loss."""
        c = self.member.config
        if self.epoch >= c.max_epochs // 2:
            self._plateau(-loss)
        else:
            turn = math.cos(math.pi * (self.epoch + 1) / c.max_epochs)
            self.rate = LOWEST_RATE + (c.lr - LOWEST_RATE) * (1 + turn) / 2

    # -- stored state --

    def packed(self) -> bytes:
        arrays = {}
        for part in ("layers", "first", "second", "best_layers"):
            for i, (w, b) in enumerate(getattr(self, part) or []):
                arrays |= {f"{part}_{i}_w": w, f"{part}_{i}_b": b}
        plain = {k: getattr(self, k) for k in (
            "rate", "step", "epoch", "lives", "best_f1", "best_epoch", "plateau_best", "plateau_bad",
            "stopped", "failed", "log")}
        plain |= {"member": asdict(self.member), "depth": len(self.layers)}
        out = io.BytesIO()
        np.savez(out, plain=np.frombuffer(json.dumps(plain).encode(), np.uint8), **arrays)
        return out.getvalue()

    @staticmethod
    def unpacked(data: bytes, member: Member) -> Learner:
        stored = np.load(io.BytesIO(data))
        plain = json.loads(stored["plain"].tobytes())
        known = plain.pop("member")
        if Config(**known["config"]).with_(max_epochs=member.config.max_epochs) != member.config:
            raise ValueError(f"{member.name} was stored with other settings")
        depth = plain.pop("depth")

        def part(name: str) -> head.Layers | None:
            if f"{name}_0_w" not in stored:
                return None
            return [(stored[f"{name}_{i}_w"], stored[f"{name}_{i}_b"]) for i in range(depth)]

        plain["log"] = [tuple(r) for r in plain["log"]]
        return Learner(member, part("layers"), part("first"), part("second"), best_layers=part("best_layers"),
                       **plain)


# -- passes over the table --------------------------------------------------

@dataclass(frozen=True)
class Table:
    """A prepared training table: ``key, x, y, fold`` (and ``batch``, by which it is cut
    into files), its width, its number of tasks, and the rows per (fold, label)."""

    rows: DataFrame
    width: int
    tasks: int
    batches: int
    counts: dict[tuple[int, int], int]


def prepare(
    df: DataFrame, fold: str | None = None, vector: str = "embedding", label: str = "label",
    row_id: str = "row_id", batches: int = 1, seed: int = 42,
) -> Table:
    """Store what training reads: vectors and labels that are not null, with the fold of
    the row (0 without a column ``fold``) and, for more than one batch per epoch, the
    row's batch by a digest of its id. Batches are folders, so a step reads its own only.
    """
    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(
        F.xxhash64(F.lit(seed), row_id).alias("key"), F.col(vector).alias("x"),
        F.col(label).cast("int").alias("y"),
        (F.lit(0) if fold is None else F.coalesce(F.col(fold), F.lit(-1))).cast("int").alias("fold"))
    if batches > 1:
        path = fresh_path(df.sparkSession, "train")
        rows.withColumn("batch", F.pmod("key", F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
        rows = df.sparkSession.read.parquet(path)
    else:
        rows = materialize(rows, "train")
    sizes = rows.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("w")).collect()
    tasks = rows.select(F.spark_partition_id().alias("task")).agg(F.max("task").alias("last")).first()["last"]
    if not sizes:
        raise ValueError("no row has a vector and a label")
    return Table(rows, max(r["w"] for r in sizes), tasks + 1, batches,
                 {(r["fold"], r["y"]): r["n"] for r in sizes})


def class_weights(table: Table, member: Member) -> np.ndarray:
    """Weight per class in training: inverse frequencies with sum 1 for several classes."""
    classes = member.config.classes
    if not member.config.multi:
        return np.ones(classes)
    n = np.zeros(classes)
    for (fold, y), count in table.counts.items():
        if fold != member.holdout:
            n[y] += count
    inverse = np.divide(1.0, n, out=np.zeros(classes), where=n > 0)
    return inverse / inverse.sum()


@dataclass(frozen=True)
class _Job:
    """What a pass computes for one member."""

    layers: head.Layers
    classes: int
    weights: np.ndarray
    holdout: int | None
    training: bool
    rate: float = 0.0
    salt: int = 0


def _sums(rows: DataFrame, jobs: Sequence[_Job], width: int, tasks: int) -> list[np.ndarray]:
    """The sums of every job over the table: one row per task, added in a tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, y, fold = (batch[c].to_numpy() for c in ("key", "y", "fold"))
            flat = batch["x"].flatten()
            if len(flat) != width * batch.num_rows or flat.null_count:
                raise ValueError(f"every vector needs {width} numbers")
            x = flat.to_numpy().astype(float).reshape(-1, width)
            parts = [_job_sums(job, keys, x, y, fold) for job in jobs]
            total = parts if total is None else [a + b for a, b in zip(total, parts)]
        if total is not None:
            part = TaskContext.get().partitionId()
            yield _sum_row(part, np.concatenate(total))

    parts = rows.select("key", "x", "y", "fold").mapInArrow(run, "part int, total binary")
    while tasks > FAN_IN:
        parts = _add_groups(parts)
        tasks = -(-tasks // FAN_IN)
    found = sorted(parts.collect(), key=lambda r: r["part"])
    sizes = [_size(j) for j in jobs]
    whole = np.zeros(sum(sizes))
    for r in found:
        whole += np.frombuffer(r["total"])
    return np.split(whole, np.cumsum(sizes)[:-1])


def _size(job: _Job) -> int:
    return 2 + job.classes**2 + (sum(w.size + b.size for w, b in job.layers) if job.training else 0)


def _job_sums(job: _Job, keys, x, y, fold) -> np.ndarray:
    mine = np.ones(len(y), bool) if job.holdout is None else (fold == job.holdout) != job.training
    if not mine.any():
        return np.zeros(_size(job))
    own = y[mine]
    if own.min() < 0 or own.max() >= job.classes:
        raise ValueError(f"labels must lie in 0..{job.classes - 1}")
    keep = None
    if job.training and job.rate > 0 and len(job.layers) > 1:
        keep = head.keep_mask(keys[mine], len(job.layers[-2][1]), job.rate, job.salt)
    return head.batch_sums(job.layers, x[mine], own, job.weights[own], job.classes, keep, job.training)


def _sum_row(part: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])


def _add_groups(parts: DataFrame) -> DataFrame:
    """Sums of ``FAN_IN`` neighbouring rows each, added in order."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total = None, None
        for batch in batches:
            for part, data in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                values = np.frombuffer(data)
                if group is not None and part // FAN_IN != group:
                    yield _sum_row(group, total)
                    total = None
                group, total = part // FAN_IN, values if total is None else total + values
        if group is not None:
            yield _sum_row(group, total)

    return parts.repartition(F.floor(F.col("part") / FAN_IN)).sortWithinPartitions("part").mapInArrow(
        add, "part int, total binary")


def measured(sums: np.ndarray, classes: int, multi: bool) -> Metrics:
    """Mean loss, accuracy and F1 (of class 1, or weighted by support) from the sums."""
    cells = sums[2 : 2 + classes * classes].reshape(classes, classes)
    rows, hits = cells.sum(), np.trace(cells)
    support, predicted, hit = cells.sum(axis=1), cells.sum(axis=0), np.diag(cells)
    f1 = np.divide(2 * hit, support + predicted, out=np.zeros(classes), where=support + predicted > 0)
    score = float((f1 * support).sum() / rows) if multi and rows else float(f1[1]) if rows else 0.0
    return Metrics(float(sums[0] / sums[1]) if sums[1] > 0 else 0.0, float(hits / rows) if rows else 0.0, score)


# -- training ---------------------------------------------------------------

def widths(config: Config, width: int) -> list[int]:
    """Layer widths of a head: ``linear`` has no hidden layer."""
    outputs = config.classes if config.multi else 1
    if config.head == "linear":
        return [width, outputs]
    return [width, *([config.redux] if config.redux else []), config.h_dim, outputs]


@dataclass
class Training:
    """Learners in the order of the members, and the number of passes over the table."""

    learners: list[Learner]
    passes: int = 0


def train(
    table: Table,
    members: Sequence[Member],
    stop_early: bool = True,
    until: int | None = None,
    path: str | None = None,
    start: Callable[[Member], head.Layers] | None = None,
    known: Training | None = None,
) -> Training:
    """Train members side by side, up to ``until`` epochs if given.

    An epoch is ``table.batches`` steps, the batches in a seeded order, and one pass over
    the validation rows. Binary heads minimise cross-entropy, others class-weighted
    cross-entropy, with L1 on the weights, gradients cut to norm 1, dropout in the last
    hidden layer, and AdamW or SGD. After an epoch the rate falls on a plateau of the F1;
    with ``stop_early`` a member ends when its lives are used up. A member without
    holdout follows half a cosine, then the plateau of its loss. A member whose loss or
    weights are no longer finite has failed and ends; others go on.

    With ``path`` the state is stored after every epoch, and members stored there go on
    from it. ``known`` goes on from a former result, ``start`` gives first weights.
    """
    spark = table.rows.sparkSession
    for m in members:
        if m.config.head not in ("linear", "relu") or m.config.opt not in ("SGD", "AdamW"):
            raise ValueError("head must be 'linear' or 'relu' and opt 'SGD' or 'AdamW'")
    stored = _load(spark, path, members) if path else {}
    for x in known.learners if known else ():
        if x.member.name not in stored or stored[x.member.name].epoch < x.epoch:
            stored[x.member.name] = x
    first = start or (lambda m: head.start_layers(widths(m.config, table.width), m.config.seed))
    done = Training([stored.get(m.name) or Learner.new(m, first(m)) for m in members], known.passes if known else 0)
    weights = {m.name: class_weights(table, m) for m in members}
    last = min(until or math.inf, max((m.config.max_epochs for m in members), default=0))
    for epoch in range(min((x.epoch for x in done.learners if x.live), default=0), int(last)):
        live = [x for x in done.learners if x.live and x.epoch == epoch]
        if not live:
            continue
        _epoch(table, live, weights, epoch, stop_early, done)
        if path:
            _save(spark, path, epoch, done.learners)
    return done


def _epoch(table: Table, live: list[Learner], weights: dict, epoch: int, stop_early: bool, done: Training) -> None:
    seed = live[0].member.config.seed
    order = np.random.default_rng([seed, epoch]).permutation(table.batches)
    losses: dict[str, list[float]] = {x.member.name: [] for x in live}
    seen = {x.member.name: 0.0 for x in live}  # sums without gradients, of training rows
    for at, batch in enumerate(order.tolist()):
        rows = table.rows.where(F.col("batch") == batch) if table.batches > 1 else table.rows
        acting = [x for x in live if not x.failed]
        salts = [(x.member.config.seed * 1_000_003 + epoch) * 1_000_003 + at for x in acting]
        jobs = [_Job(x.layers, x.member.config.classes, weights[x.member.name], x.member.holdout, True,
                     x.member.config.drop_rate, s) for x, s in zip(acting, salts)]
        if not jobs:
            return
        for x, sums in zip(acting, _sums(rows, jobs, table.width, table.tasks)):
            losses[x.member.name].append(x.learn(sums))
            seen[x.member.name] = seen[x.member.name] + sums[: 2 + x.member.config.classes**2]
        done.passes += 1 if at == 0 else 0
    acting = [x for x in live if not x.failed]
    judged = [x for x in acting if x.member.holdout is not None]
    jobs = [_Job(x.layers, x.member.config.classes, weights[x.member.name], x.member.holdout, False) for x in judged]
    rows = table.rows.where(F.col("fold").isin(sorted({x.member.holdout for x in judged})))
    found = dict(zip((x.member.name for x in judged), _sums(rows, jobs, table.width, table.tasks) if jobs else []))
    for x in acting:
        name, c = x.member.name, x.member.config
        sums = found.get(name, seen[name])
        x.end_epoch(measured(sums, c.classes, c.multi), sum(losses[name]) / len(losses[name]), stop_early)


def _save(spark: SparkSession, path: str, epoch: int, learners: Sequence[Learner]) -> None:
    rows = [(x.member.name, x.packed()) for x in learners]
    spark.createDataFrame(rows, "member string, state binary").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/epoch={epoch}")


def _load(spark: SparkSession, path: str, members: Sequence[Member]) -> dict[str, Learner]:
    """The latest stored state of every member. An epoch whose writing was cut off left no
    file, so the one before counts."""
    try:
        states = spark.read.schema(STATE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    known = {m.name: m for m in members}
    latest = states.where(F.col("member").isin(list(known))).groupBy("member").agg(
        F.max_by("state", "epoch").alias("state"))
    return {r["member"]: Learner.unpacked(bytes(r["state"]), known[r["member"]]) for r in latest.collect()}
