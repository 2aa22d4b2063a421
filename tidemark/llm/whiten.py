"""Operator 11: whitening by block Jacobi-Davidson on distributed centred products.

The covariance is never built. Its product with a block of vectors is one Spark job over the
stored rows: every task centres its rows, multiplies and adds up; partial sums of dimension
times block size meet in two levels. The driver holds the subspace alone: Rayleigh-Ritz
gives approximate pairs, those whose residuals reach double precision are locked, and the others
are corrected by projected equations, which MINRES solves for the whole block at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, stored

COMPONENTS = 32
SCALE, OFFSET = 64.0, 1_000_000
# Larger entries are cut to this size, so that scaled entries stay exact in double precision.
GREATEST = 2.0**44
EXTRA = 8
INNER_STEPS = 12
OUTER_STEPS = 60
# Residuals in units of the largest eigenvalue: 64 units in the last place.
TOLERANCE = 64 * 2.0**-52
PARTIALS = 64


def scaled_rows(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(key, x): floor(64 c) + 1000000 of rows without null or non-finite entries, stored."""
    source = vectors.select(vectors[id_column].alias("key"), vectors[vector_column].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    source = source.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    long = F.transform("v", lambda c: F.floor(F.greatest(F.lit(-GREATEST), F.least(F.lit(GREATEST), c)) * SCALE) + OFFSET)
    return stored(source.select("key", long.alias("x")), "scaled-vectors")


@dataclass
class Moments:
    """Number of rows and their exact sums by dimension, as Python integers."""

    n: int
    sums: list[int]

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centre(self, x):
        """Rows minus the mean; whole numbers are subtracted first, so nothing is lost to the offset."""
        import numpy as np

        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest


def _matrix(column, dim: int):
    """A list column of rows of ``dim`` numbers as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def moments(rows: DataFrame, dim: int) -> Moments:
    def add(batches: Iterator) -> Iterator:
        import decimal

        import pyarrow as pa

        n, sums = 0, [0] * dim
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            n += len(x)
            # At most 2**51 times the rows of a batch: no overflow.
            sums = [s + t for s, t in zip(sums, x.sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, dim), pa.int32()), pa.array([decimal.Decimal(v) for v in (n, *sums)], pa.decimal128(38, 0))], ["place", "v"]
        )

    found = rows.select("x").mapInArrow(add, "place int, v decimal(38,0)").groupBy("place").agg(F.sum("v").alias("v")).collect()
    totals = {r["place"]: int(r["v"]) for r in found}
    return Moments(totals.get(-1, 0), [totals.get(i, 0) for i in range(dim)])


def _summed(rows: DataFrame, dim: int, shape: tuple[int, int], partial: Callable):
    """Sum over all rows of the matrices that ``partial`` makes of each batch of rows.

    Partial sums meet in at most PARTIALS tasks before the driver adds those; their order is fixed,
    so that a repeated job gives the same bits.
    """
    import numpy as np

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros(shape, np.longdouble)
        for batch in batches:
            if batch.num_rows:
                total += partial(_matrix(batch.column(0), dim))
        high = total.astype(np.float64)
        both = np.stack([high, (total - high).astype(np.float64)])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([both.tobytes()], pa.binary())], ["part", "sums"])

    def meet(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, first = np.zeros(shape, np.longdouble), None
        for batch in batches:
            for part, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                first = part if first is None else first
                high, low = np.frombuffer(sums.as_py()).reshape(2, *shape)
                total += high.astype(np.longdouble) + low
        if first is not None:
            high = total.astype(np.float64)
            both = np.stack([high, (total - high).astype(np.float64)])
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([both.tobytes()], pa.binary())], ["part", "sums"])

    parts = rows.select("x").mapInArrow(add, "part int, sums binary")
    if rows.rdd.getNumPartitions() > PARTIALS:
        parts = parts.repartition(PARTIALS, F.col("part") % PARTIALS).sortWithinPartitions("part").mapInArrow(meet, "part int, sums binary")
    total = np.zeros(shape, np.longdouble)
    for r in sorted(parts.collect()):
        high, low = np.frombuffer(r["sums"]).reshape(2, *shape)
        total += high.astype(np.longdouble) + low
    return total.astype(np.float64)


def product(rows: DataFrame, m: Moments) -> Callable:
    """The function that multiplies the covariance by a block of columns, without building it."""

    def times(block):
        def partial(x):
            z = m.centre(x)
            return z.T @ (z @ block)

        return _summed(rows, m.dim, block.shape, partial) / m.n

    return times


def _orthonormal(block, against):
    """The block's directions orthogonal to the columns of ``against``; null directions are left out."""
    import numpy as np

    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
    left, values, _ = np.linalg.svd(block, full_matrices=False)
    left = left[:, values > 1e-10]
    return left - against @ (against.T @ left)


def _tidy(block, against):
    """Orthonormal to rounding: once more against the subspace and itself."""
    import numpy as np

    return np.linalg.qr(_orthonormal(block, against))[0] if block.shape[1] else block


def minres(times: Callable, shifts, project: Callable, rhs, steps: int, reduce: float = 1e-3):
    """MINRES for each column: project (A - shift) project t = rhs, at most ``steps`` products.

    All columns share each product; a column stops when its residual has shrunk to ``reduce``.
    """
    import numpy as np

    x = np.zeros_like(rhs)
    beta = np.linalg.norm(rhs, axis=0)
    first = np.where(beta > 0, beta, 1.0)
    v, before = rhs / first, np.zeros_like(rhs)
    eta, old_beta = beta.copy(), np.zeros_like(beta)
    c0 = c1 = np.ones_like(beta)
    s0 = s1 = np.zeros_like(beta)
    w0, w1 = np.zeros_like(rhs), np.zeros_like(rhs)
    live = beta > 0
    for _ in range(steps):
        if not live.any():
            break
        u = np.zeros_like(v)
        u[:, live] = times(v[:, live])
        u = project(u - v * shifts)
        alpha = (v * u).sum(axis=0)
        u = u - v * alpha - before * old_beta
        new_beta = np.linalg.norm(u, axis=0)
        # Two earlier rotations, then the one that clears the new entry.
        delta = c1 * alpha - c0 * s1 * old_beta
        rho2 = s1 * alpha + c0 * c1 * old_beta
        rho3 = s0 * old_beta
        rho1 = np.hypot(delta, new_beta)
        usable = live & (rho1 > 0)
        safe = np.where(usable, rho1, 1.0)
        c0, s0 = c1, s1
        c1, s1 = np.where(usable, delta / safe, 1.0), np.where(usable, new_beta / safe, 0.0)
        w = (v - w0 * rho3 - w1 * rho2) / safe
        x = x + np.where(usable, c1 * eta, 0.0) * w
        eta = -s1 * eta
        w0, w1 = w1, w
        before, old_beta = v, new_beta
        live = usable & (new_beta > 1e-14 * np.abs(alpha)) & (np.abs(eta) > reduce * beta)
        v = u / np.where(new_beta > 0, new_beta, 1.0)
    return x


def jacobi_davidson(times: Callable, dim: int, wanted: int, tolerance: float = TOLERANCE, seed: int = 5):
    """The ``wanted`` largest eigenpairs of a symmetric operator: (values, vectors, residuals).

    Ritz pairs are locked from the largest on, each when its residual is at most ``tolerance`` times the
    largest value. A random block at the end looks for a pair that the subspace has missed.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    wanted = min(wanted, dim)
    block = min(dim, wanted + EXTRA)
    most = max(3 * block, 2 * wanted)
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    basis = np.linalg.qr(rng.standard_normal((dim, block)))[0]
    image = times(basis)
    probed, best = False, np.inf
    for step in range(OUTER_STEPS):
        theta, mix = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        theta, mix = theta[::-1], mix[:, ::-1]
        basis, image = basis @ mix, image @ mix
        top = max([*np.abs(values), *np.abs(theta), 0.0])
        if top == 0.0:
            take = min(wanted - len(values), len(theta))
            locked, values = np.hstack([locked, basis[:, :take]]), np.concatenate([values, theta[:take]])
            break
        need = min(wanted - len(values), len(theta))
        residual = image[:, :need] - basis[:, :need] * theta[:need]
        size = np.linalg.norm(residual, axis=0)
        good = size <= tolerance * top
        done = int(np.argmin(good)) if not good.all() else need
        if probed and need and theta[0] <= values[-1] * (1 + 1e-9):
            break
        locked, values = np.hstack([locked, basis[:, :done]]), np.concatenate([values, theta[:done]])
        basis, image, theta, residual, size = basis[:, done:], image[:, done:], theta[done:], residual[:, done:], size[done:]
        if len(values) == wanted:
            if probed or locked.shape[1] + basis.shape[1] >= dim:
                break
            # Nothing outside the locked vectors may lie above the smallest of them.
            probed = True
            extra = _tidy(rng.standard_normal((dim, min(EXTRA, dim - locked.shape[1] - basis.shape[1]))), np.hstack([locked, basis]))
            for _ in range(3):
                seen = times(extra)
                basis, image = np.hstack([basis, extra]), np.hstack([image, seen])
                extra = _tidy(seen, np.hstack([locked, basis]))[:, :EXTRA]
                if not extra.shape[1]:
                    break
            inner, mixed = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
            if inner[-1] <= values.min() + tolerance * top:
                break
            basis, image = np.hstack([locked, basis]), np.hstack([times(locked), image])
            locked, values, probed = np.zeros((dim, 0)), np.zeros(0), False
            continue
        if basis.shape[1] + block > most:
            basis, image, theta = basis[:, :block], image[:, :block], theta[:block]
        now = min(need - done, basis.shape[1])
        if locked.shape[1] + basis.shape[1] >= dim:
            # The subspace is everything: only rounding is left, one fresh product tells how much.
            basis = np.linalg.qr(basis - locked @ (locked.T @ basis))[0]
            image = times(basis)
            level = float(size[:now].max())
            if level >= best / 2:
                tolerance = max(tolerance, 2 * level / top)
            best = min(best, level)
            continue
        held = np.hstack([locked, basis[:, :now]])
        project = lambda t, held=held: t - held @ (held.T @ t)
        correction = minres(times, theta[:now], project, -project(residual[:, :now]), INNER_STEPS)
        extra = _tidy(np.hstack([correction, residual[:, :now]]) if step % 3 == 2 else correction, np.hstack([locked, basis]))
        extra = extra[:, : dim - locked.shape[1] - basis.shape[1]]
        level = float(size[:now].max())
        if not extra.shape[1] or (level >= best / 2 and step > OUTER_STEPS // 2):
            tolerance = max(tolerance, 2 * level / top)
        best = min(best, level)
        if extra.shape[1]:
            basis, image = np.hstack([basis, extra]), np.hstack([image, times(extra)])
    if len(values) < wanted:
        raise ArithmeticError(f"{wanted - len(values)} of {wanted} eigenpairs left after {OUTER_STEPS} steps")
    # One more Rayleigh-Ritz step over what is locked.
    locked = np.linalg.qr(locked)[0]
    image = times(locked)
    theta, mix = np.linalg.eigh((locked.T @ image + image.T @ locked) / 2)
    theta, vectors, image = theta[::-1], (locked @ mix)[:, ::-1], (image @ mix)[:, ::-1]
    return theta, vectors, np.linalg.norm(image - vectors * theta, axis=0)


def whitened(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue per row and component.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped. Where lengths
    differ, the rows of the commonest length (ties: the longest) are whitened and the others are
    dropped. Null ids stay; repeated rows count each time. Components whose eigenvalue is zero to
    rounding cannot be whitened and are left out, so equal or single rows and empty tables yield no
    rows. ``deviation`` is null where it passes 64 bits.
    """
    import numpy as np

    spark = vectors.sparkSession
    small_batches(spark)
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = "vec_id {}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, eigenvalue double".format(kind)
    rows = scaled_rows(vectors, id_column, vector_column)
    length = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    dim = length["dim"]
    rows = rows.where(F.size("x") == dim)
    m = moments(rows, dim)

    def squares(x):
        z = m.centre(x)
        return np.array([[np.square(z).sum()]])

    trace = float(_summed(rows, dim, (1, 1), squares)[0, 0]) / m.n
    if trace == 0.0:
        return spark.createDataFrame([], schema)
    values, axes, _ = jacobi_davidson(product(rows, m), dim, components)
    kept = values > 1e-13 * trace
    values, axes = values[kept], axes[:, kept]
    scaled = axes / np.sqrt(values)
    count = len(values)

    def gram(x):
        w = m.centre(x) @ scaled
        return np.vstack([w.T @ w, w.sum(axis=0)])

    sums = _summed(rows, dim, (count + 1, count), gram) / m.n
    error = float(np.abs(sums[:-1] - np.outer(sums[-1], sums[-1]) - np.eye(count)).max())
    explained = values / trace

    def project(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dim)
            rows_now = len(x)
            w = m.centre(x) @ scaled
            whole = np.array([s // m.n for s in m.sums], np.int64)
            away, rest = x - whole, np.array([s % m.n for s in m.sums], np.int64)
            deviation = [d if d < 2**63 else None for d in _exact_squares(away, rest, m.n)]
            at = pa.array(np.repeat(np.arange(rows_now), count))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows_now)),
                    pa.array(np.full(rows_now * count, m.n, np.int64)), pa.array(deviation, pa.int64()).take(at), pa.array(w.reshape(-1)),
                    pa.array(np.tile(explained, rows_now)), pa.array(np.full(rows_now * count, error)), pa.array(np.tile(values, rows_now)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"],
            )

    return rows.select("key", "x").mapInArrow(project, schema)


def _exact_squares(away, rest, n: int) -> list[int]:
    """Sums over dimensions of (n away - rest)**2 as exact integers.

    Expanded into n**2 sum(away**2) - 2 n sum(away rest) + sum(rest**2); the three sums are exact in
    long arithmetic while entries are moderate, and in Python's integers beyond that.
    """
    import numpy as np

    dim = away.shape[1]
    top = int(np.abs(away).max(initial=0))
    if top * max(top, n) * dim < 2**62:
        squares, mixed = np.square(away).sum(axis=1).tolist(), (away * rest).sum(axis=1).tolist()
    else:
        squares = [sum(v * v for v in row) for row in away.tolist()]
        mixed = [sum(v * r for v, r in zip(row, rest.tolist())) for row in away.tolist()]
    last = sum(r * r for r in rest.tolist())
    return [n * n * s - 2 * n * t + last for s, t in zip(squares, mixed)]
