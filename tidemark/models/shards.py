"""One Spark stage that trains tree ensembles.

Rows are dealt to as many tasks as their number asks for. Several tasks form a barrier stage
and add up their histograms by ``BarrierTaskContext.allGather``; all of them grow the same trees, and
the first one returns them. Such a round takes Spark about a second, so all ensembles of a call share
their rounds. Rows that fit one task need no barrier: then the ensembles are dealt out
instead, each task with a copy of that bounded table. A task keeps bins and one prediction
a row. A lost task of a barrier stage restarts the stage; hashes take the place of random numbers,
so the trees are the same.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import feature_stages
from .growing import KINDS, Binned, TreeParams
from .packed import SHAPES, EnsembleForecaster, Trees, combine, mapped, pack, unpack

ROWS_PER_TASK = 1_000_000
BINS = 255
ACCURACY = 10_000


@dataclass
class Space:
    """Where trees split: features after one affine map, with their bin edges."""

    matrix: np.ndarray | None
    offset: np.ndarray | None
    edges: list[np.ndarray]


@dataclass
class Job:
    """One ensemble: parameters, space, and the positions it learns from and is tested on (None: all rows, none)."""

    params: TreeParams
    space: int = 0
    train_end: int | None = None
    test_end: int | None = None


def affine(train: DataFrame, features: Sequence[str], scale: bool, pca: float | None):
    """(matrix, offset) of scaling and principal components fitted on the rows; (None, None) for neither."""
    if not scale and not pca:
        return None, None
    return affine_of(Pipeline(stages=feature_stages(features, scale, pca, "features")).fit(train), len(features))


def affine_of(fitted: PipelineModel, size: int):
    """(matrix, offset) of fitted feature stages over ``size`` features."""
    matrix, offset = np.eye(size), np.zeros(size)
    for stage in fitted.stages[1:]:
        for part in stage.stages:
            if hasattr(part, "mean"):
                deviation = part.std.toArray()
                factor = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)
                matrix, offset = matrix * factor, (offset - part.mean.toArray()) * factor
            elif hasattr(part, "pc"):
                matrix, offset = matrix @ part.pc.toArray(), offset @ part.pc.toArray()
            elif hasattr(part, "getScalingVec"):
                factor = part.getScalingVec().toArray()
                matrix, offset = matrix * factor, offset * factor
            else:
                keep = part.getIndices()
                matrix, offset = matrix[:, keep], offset[keep]
    return np.ascontiguousarray(matrix), offset


def _columns(features: Sequence[str], matrix, offset) -> list[Column]:
    """The space's columns in SQL, with the operations of :func:`packed.mapped` in their order."""
    plain = [F.col(f).cast("double") for f in features]
    if matrix is None:
        return plain
    out = []
    for c in range(matrix.shape[1]):
        total = F.lit(float(offset[c]))
        for j, x in enumerate(plain):
            total = total + x * F.lit(float(matrix[j, c]))
        out.append(total)
    return out


def quantile_edges(train: DataFrame, columns: Sequence[tuple[Column, Column | None]], bins: int = BINS) -> list[np.ndarray]:
    """Bin edges of each column (over the rows where its condition holds): up to ``bins - 1`` of its quantiles, one aggregate for all."""
    shares = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    cells = []
    for i, (column, condition) in enumerate(columns):
        valid = column if condition is None else F.when(condition, column)
        cells.append(F.percentile_approx(F.when(~F.isnan(valid), valid), shares, ACCURACY).alias(f"q{i}"))
    row = train.agg(*cells).first()
    return [np.unique(np.array(row[f"q{i}"] or [], float)) for i in range(len(columns))]


def spaces(train: DataFrame, features: Sequence[str], kinds: Sequence[tuple[bool, float | None, int | None]], order: str = "pos") -> list[Space]:
    """The space of every (scale, pca, end of the train rows); all edges come from one aggregate."""
    def fitted(kind):
        scale, pca, end = kind
        return affine(train if end is None else train.where(F.col(order) < end), features, scale, pca)

    with ThreadPool(4) as pool:
        maps = pool.map(fitted, kinds)
    wanted = []
    for (matrix, offset), (_, _, end) in zip(maps, kinds):
        wanted.append([(c, None if end is None else F.col(order) < end) for c in _columns(features, matrix, offset)])
    edges = iter(quantile_edges(train, [c for some in wanted for c in some]))
    return [Space(matrix, offset, [next(edges) for _ in some]) for (matrix, offset), some in zip(maps, wanted)]


def _gather(sums: list[np.ndarray], highs: list[np.ndarray]):
    """Sums and largest values of all tasks' arrays, by one message a task."""
    from pyspark import BarrierTaskContext

    flat = np.concatenate([a.reshape(-1) for a in [*sums, *highs]])
    split = sum(a.size for a in sums)
    every = np.stack([np.frombuffer(base64.b64decode(m)) for m in BarrierTaskContext.get().allGather(base64.b64encode(flat.tobytes()).decode())])
    total = np.concatenate([every[:, :split].sum(axis=0), every[:, split:].max(axis=0)])
    out, at = [], 0
    for a in [*sums, *highs]:
        out.append(total[at : at + a.size].reshape(a.shape))
        at += a.size
    return out[: len(sums)], out[len(sums) :]


def run_together(made: dict, gather) -> dict:
    """Run coroutines in lock step, so that each round sends one message for all of them."""
    done, asked = {}, {}

    def step(name, value):
        try:
            asked[name] = made[name].send(value)
        except StopIteration as end:
            asked.pop(name, None)
            done[name] = end.value

    for name in made:
        step(name, None)
    while asked:
        sums = [n for n, (how, _) in asked.items() if how == "sum"]
        highs = [n for n, (how, _) in asked.items() if how == "max"]
        answers = gather([asked[n][1] for n in sums], [asked[n][1] for n in highs])
        for names, found in zip((sums, highs), answers):
            for name, value in zip(names, found):
                step(name, value)
    return done


def train_alone(made):
    """Run one coroutine whose rows are all here."""
    try:
        _, value = next(made)
        while True:
            _, value = made.send(value)
    except StopIteration as end:
        return end.value


def _work(job: Job, space: Space, x, y, key, pos, cache: dict):
    """The coroutine of a job: fit, then the squared error over its test rows."""
    mine = np.ones(len(y), bool) if job.train_end is None else pos < job.train_end
    at = (job.space, job.train_end)
    if at not in cache:
        cache[at] = Binned(mapped(x[mine], space.matrix, space.offset), space.edges)
    fitted = yield from KINDS[job.params.kind](cache[at], y[mine], key[mine], job.params)
    fitted["error"] = None
    if job.test_end is not None:
        held = (pos >= job.train_end) & (pos < job.test_end)
        leaves = fitted["ensemble"].leaves(mapped(x[held], space.matrix, space.offset))
        missed = combine(leaves, fitted["how"], fitted["base"], fitted["weights"]) - y[held]
        squares, n = yield "sum", np.array([np.square(missed).sum(), float(len(missed))])
        fitted["error"] = squares / n if n else float("nan")
    return fitted


def _packed(fitted: dict) -> bytes:
    shape = next(name for name, kind in SHAPES.items() if isinstance(fitted["ensemble"], kind))
    error = np.nan if fitted["error"] is None else fitted["error"]
    return pack(__shape=np.array(shape), __how=np.array(fitted["how"]), __base=np.array(fitted["base"]), __weights=fitted["weights"], __error=np.array(error), **fitted["ensemble"].arrays())


def _unpacked(data: bytes) -> dict:
    found = unpack(data)
    shape, how = str(found.pop("__shape")), str(found.pop("__how"))
    fixed = {k: found.pop(f"__{k}") for k in ("base", "weights", "error")}
    return {"ensemble": SHAPES[shape](**found), "how": how, "base": float(fixed["base"]), "weights": fixed["weights"], "error": float(fixed["error"])}


def train_jobs(rows: DataFrame, features: Sequence[str], target: str, jobs: Sequence[Job], where: Sequence[Space], order: str | None = None, rows_per_task: int = ROWS_PER_TASK) -> list[dict]:
    """Train every job in one stage: ``ensemble, how, base, weights, error`` by job.

    Rows without a target teach nothing. ``order`` names the positions that ``train_end`` and
    ``test_end`` speak of.
    """
    spark = rows.sparkSession
    plain = [F.col(f).cast("double") for f in features]
    y = F.col(target).cast("double")
    place = F.lit(0).cast("bigint") if order is None else F.col(order).cast("bigint")
    source = rows.select(F.array(*plain).alias("x"), y.alias("y"), F.xxhash64(*plain, y).alias("key"), place.alias("pos")).where("y is not null and not isnan(y)")
    slots = spark.sparkContext.defaultParallelism
    shards = max(1, min(slots, -(-source.count() // rows_per_task)))
    cost = lambda j: j.params.trees * min(j.params.leaves if j.params.grow == "leaf" else 99, 2 ** min(j.params.depth, 6))
    ordered = sorted(range(len(jobs)), key=lambda i: (-cost(jobs[i]), i))
    groups = min(slots, len(jobs)) if shards == 1 else 1
    jobs, where = list(jobs), list(where)

    def train(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        parts = [(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(features)), *(b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))) for b in batches if b.num_rows]
        empty = (np.empty((0, len(features))), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
        x, y, key, pos = (np.concatenate(p) for p in zip(*parts)) if parts else empty
        # Rows in the order of their hashes: how they arrived makes no difference.
        sort = np.lexsort((y, key, pos))
        x, y, key, pos = x[sort].astype(float), y[sort], key[sort].view(np.uint64), pos[sort]
        part, cache = TaskContext.get().partitionId(), {}
        mine = ordered[part::groups] if shards == 1 else ordered
        work = {i: _work(jobs[i], where[jobs[i].space], x, y, key, pos, cache) for i in mine}
        found = {i: train_alone(w) for i, w in work.items()} if shards == 1 else run_together(work, _gather)
        if shards == 1 or part == 0:
            for i, fitted in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([_packed(fitted)], pa.binary())], ["job", "model"])

    if shards == 1:
        source = source.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartitionById(groups, F.col("group")).drop("group")
    else:
        source = source.repartition(shards)
    made = source.mapInArrow(train, "job int, model binary", barrier=shards > 1).collect()
    return [_unpacked(bytes(r["model"])) for r in sorted(made)]


def joined(parts: Sequence[dict]) -> dict:
    """Several runs of one forest as one."""
    return {**parts[0], "ensemble": Trees.join([p["ensemble"] for p in parts])}


def pieces(params: TreeParams, count: int) -> list[TreeParams]:
    """A forest cut into runs of trees that may be grown apart."""
    cuts = np.linspace(0, params.trees, min(count, params.trees) + 1).astype(int)
    return [replace(params, trees=int(b - a), first_tree=int(a)) for a, b in zip(cuts, cuts[1:])]


def fit_ensembles(
    train: DataFrame, features: Sequence[str], target: str, wanted: Sequence[tuple[TreeParams, bool, float | None]], rows_per_task: int = ROWS_PER_TASK
) -> list[EnsembleForecaster]:
    """Grow several ensembles, each of (parameters, scaled?, components), in one stage over binned features."""
    known = train.where(F.col(target).isNotNull())
    kinds = list(dict.fromkeys((scale, pca, None) for _, scale, pca in wanted))
    where = spaces(known, features, kinds)
    slots = train.sparkSession.sparkContext.defaultParallelism
    jobs, owner = [], []
    for i, (params, scale, pca) in enumerate(wanted):
        for run in pieces(params, slots) if params.kind == "forest" else [params]:
            jobs.append(Job(run, kinds.index((scale, pca, None))))
            owner.append(i)
    found = train_jobs(known, features, target, jobs, where, rows_per_task=rows_per_task)
    out = []
    for i in range(len(wanted)):
        mine = [f for f, o in zip(found, owner) if o == i]
        made, space = joined(mine) if len(mine) > 1 else mine[0], where[jobs[owner.index(i)].space]
        out.append(EnsembleForecaster(features, made["ensemble"], made["how"], made["base"], made["weights"], space.matrix, space.offset))
    return out


def fit_ensemble(
    train: DataFrame, features: Sequence[str], target: str, params: TreeParams, scale: bool = False, pca: float | None = None, rows_per_task: int = ROWS_PER_TASK
) -> EnsembleForecaster:
    """:func:`fit_ensembles` of one."""
    return fit_ensembles(train, features, target, [(params, scale, pca)], rows_per_task)[0]
