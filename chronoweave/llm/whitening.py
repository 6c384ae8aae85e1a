"""Whitening of embeddings by principal components, through a one-sided Jacobi SVD of a blockwise QR.

Entries become whole numbers floor(SCALE * c) + SHIFT, so counts and sums are exact. Rows less their mean, each entry
(n * x - sum) / n of an exact numerator, are compressed by QR, block by block in each task; the triangles of tasks are
stacked FAN at a time and compressed again, in rounds of a tree, until one is left (its size is the square of the
dimension, at most MOST squared). Plane rotations, of disjoint pairs side by side, make that triangle's columns
orthogonal: the products of all rotations are the components, the columns' lengths the deviations times sqrt(n). The
whitened rows' covariance, centred in each block and merged with the blocks' means in the same tree, tells how far
it is from the identity.

Rows are read once for each of: sums, triangles, covariance, result; no vector is ever shuffled. What goes to the
driver is a row of sums, a triangle and a small covariance for each dimension that vectors have.

Defined cases: vectors that are null or empty or hold null or non-finite entries are dropped; zero vectors and rows
with a null id take part; repeated rows count each; vectors of different lengths are lists of their own, each with
its own n and components; a component without variance beyond rounding has whitened and explained 0 and is left out
of identity_error (0 if none has any); a deviation beyond 64 bits is null; an empty table gives an empty result; other
columns are not read. Vectors longer than MOST are an error. A task holds BLOCK rows and FAN triangles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import batch, forget, keep

SCALE, SHIFT, COMPONENTS, BLOCK, FAN, MOST = 1024.0, 100_000, 8, 4096, 16, 2048
PART = pa.schema([("slot", pa.int64()), ("dim", pa.int32()), ("part", pa.binary())])
PART_SQL = "slot long, dim int, part binary"
#: A component's variance counts as none below this share of the whole.
NOTHING = 1e-14


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _blocks(batches, column: int):
    """Batches of at most BLOCK rows: dimension, the rows' numbers in the batch, whole numbers [row, entry]."""
    for b in batches:
        for begin in range(0, b.num_rows, BLOCK):
            own = b.slice(begin, BLOCK)
            vectors = own.column(column)
            sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                flat = pc.list_flatten(vectors.take(pa.array(rows))).to_numpy(zero_copy_only=False).astype(np.float64)
                yield own, dim, rows, (np.floor(SCALE * flat) + SHIFT).astype(np.int64).reshape(len(rows), dim)


def _merged(parts: DataFrame, fold) -> dict[int, bytes]:
    """One part for each dimension from one for each task and dimension: FAN at a time, in rounds of a tree. Slots are
    dealt by the tasks' numbers, so that a round's groups have FAN parts at most."""

    def joined(batches):
        held: dict[tuple, list[bytes]] = {}
        for b in batches:
            for slot, dim, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = held.setdefault((slot, dim), [])
                own.append(part)
                if len(own) == FAN:
                    held[slot, dim] = [fold(own, dim)]
        for (slot, dim), own in sorted(held.items()):
            yield batch(PART, [slot], [dim], [fold(own, dim)])

    old = keep(parts, "whitening-parts")
    many = old.agg(F.max("slot")).first()[0]
    while many:
        dealt = old.withColumn("slot", F.floor(F.col("slot") / FAN)).repartition(many // FAN + 1, "slot")
        new = keep(dealt.mapInArrow(joined, PART_SQL), "whitening-parts")
        forget(old)
        old, many = new, many // FAN
    held = {r.dim: bytes(r.part) for r in old.select("dim", "part").collect()}
    forget(old)
    return held


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _sums(batches):
    """Count and sums of each dimension's rows in a task, exact."""
    held: dict[int, np.ndarray] = {}
    for _, dim, _, x in _blocks(batches, 0):
        own = held.setdefault(dim, np.zeros(dim + 1, np.int64))
        own += np.append(len(x), x.sum(0))
    for dim, own in held.items():
        yield batch(PART, [_task()], [dim], [own.tobytes()])


def _added(parts: list[bytes], dim: int) -> bytes:
    return np.sum([np.frombuffer(p, np.int64) for p in parts], axis=0).tobytes()


def _centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    return (n * x - s) / n


def compressed(rows: np.ndarray) -> np.ndarray:
    """The triangle R of the rows, square whatever their number."""
    dim = rows.shape[1]
    return np.linalg.qr(np.vstack([rows, np.zeros((max(0, dim - len(rows)), dim))]), mode="r")


def _stacked(parts: list[bytes], dim: int) -> bytes:
    return compressed(np.vstack([np.frombuffer(p).reshape(dim, dim) for p in parts])).tobytes()


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of r's orthogonalised columns, falling, and the rotations' product, whose columns are r's right singular
    vectors. Each round of a sweep rotates disjoint pairs, so that all of them turn at once."""
    dim, least = r.shape[1], np.finfo(float).eps * np.sqrt(r.shape[1])
    even = dim + dim % 2
    a, v = np.zeros((r.shape[0], even)), np.eye(even)
    a[:, :dim] = r
    ring = np.arange(even)
    for _ in range(sweeps):
        turned = False
        for _ in range(even - 1):
            p, q = ring[: even // 2], ring[even // 2 :][::-1]
            ap, aq = a[:, p], a[:, q]
            alpha, beta, gamma = (np.einsum("ij,ij->j", x, y) for x, y in ((ap, ap), (aq, aq), (ap, aq)))
            go = np.abs(gamma) > least * np.sqrt(alpha * beta)
            if go.any():
                turned = True
                p, q, g = p[go], q[go], gamma[go]
                apart = beta[go] - alpha[go]
                t = 2 * g * np.where(apart >= 0, 1.0, -1.0) / (np.abs(apart) + np.hypot(apart, 2 * g))
                c = 1 / np.hypot(1, t)
                s = c * t
                for m in (a, v):
                    mp, mq = m[:, p].copy(), m[:, q]
                    m[:, p], m[:, q] = c * mp - s * mq, s * mp + c * mq
            ring = np.append(ring[:1], np.roll(ring[1:], 1))
        if not turned:
            break
    a, v = a[:, :dim], v[:dim, :dim]  # the column added to make them even is zero and is never turned
    lengths = np.linalg.norm(a, axis=0)
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order]


def fit(df: DataFrame, vector_col: str = "embedding") -> dict[int, dict]:
    """For each dimension: n, sums, trace, and of up to COMPONENTS components the eigenvalues e, the vectors and the
    vectors over sqrt(e)."""
    vectors = df.where(usable(F.col(vector_col))).select(F.col(vector_col).cast("array<double>").alias("v"))
    sums = {d: np.frombuffer(p, np.int64) for d, p in _merged(vectors.mapInArrow(_sums, PART_SQL), _added).items()}
    if any(d > MOST for d in sums):
        raise ValueError(f"vectors of more than {MOST} entries")
    sent = df.sparkSession.sparkContext.broadcast(sums)

    def triangles(batches):
        held: dict[int, np.ndarray] = {}
        for _, dim, _, x in _blocks(batches, 0):
            n, s = int(sent.value[dim][0]), sent.value[dim][1:]
            rows = _centred(x, n, s)
            held[dim] = compressed(np.vstack([held[dim], rows]) if dim in held else rows)
        for dim, r in held.items():
            yield batch(PART, [_task()], [dim], [r.tobytes()])

    model = {}
    for dim, part in _merged(vectors.mapInArrow(triangles, PART_SQL), _stacked).items():
        n, s = int(sums[dim][0]), sums[dim][1:]
        lengths, v = jacobi(np.frombuffer(part).reshape(dim, dim))
        e = lengths**2 / n
        trace, k = float(e.sum()), min(COMPONENTS, dim)
        real = e[:k] > NOTHING * trace
        e, v = np.where(real, e[:k], 0.0), v[:, :k]
        model[dim] = {"n": n, "sums": s, "trace": trace, "e": e, "components": v, "whiten": np.where(real, v / np.sqrt(np.where(real, e, 1)), 0.0)}
    return model


def _spread(parts: list[bytes], k: int) -> bytes:
    """Counts, means and centred products of several blocks as one."""
    n, mean, m2 = 0.0, np.zeros(k), np.zeros((k, k))
    for p in parts:
        own = np.frombuffer(p)
        d, total = own[1 : k + 1] - mean, n + own[0]
        m2 = m2 + own[k + 1 :].reshape(k, k) + np.outer(d, d) * (n * own[0] / total)
        mean, n = mean + d * (own[0] / total), total
    return np.concatenate([[n], mean, m2.reshape(-1)]).tobytes()


def identity_errors(df: DataFrame, model: dict[int, dict], vector_col: str = "embedding") -> dict[int, float]:
    """For each dimension the largest absolute entry of the whitened rows' covariance less the identity."""
    vectors = df.where(usable(F.col(vector_col))).select(F.col(vector_col).cast("array<double>").alias("v"))
    sent = df.sparkSession.sparkContext.broadcast(model)

    def spread(batches):
        held: dict[int, bytes] = {}
        for _, dim, _, x in _blocks(batches, 0):
            m = sent.value[dim]
            z = _centred(x, m["n"], m["sums"]) @ m["whiten"]
            mean = z.mean(0)
            own = np.concatenate([[len(z)], mean, ((z - mean).T @ (z - mean)).reshape(-1)]).tobytes()
            held[dim] = _spread([held[dim], own], z.shape[1]) if dim in held else own
        for dim, own in held.items():
            yield batch(PART, [_task()], [dim], [own])

    out = {}
    for dim, part in _merged(vectors.mapInArrow(spread, PART_SQL), lambda parts, d: _spread(parts, min(COMPONENTS, d))).items():
        own, k = np.frombuffer(part), min(COMPONENTS, dim)
        real = model[dim]["e"] > 0
        off = np.abs(own[k + 1 :].reshape(k, k) / own[0] - np.eye(k))[np.ix_(real, real)]
        out[dim] = float(off.max()) if off.size else 0.0
    return out


def deviations(x: np.ndarray, n: int, s: np.ndarray) -> list[int | None]:
    """Sums of squares of n * x - s for each row, exact."""
    d = n * x - s
    if d.shape[1] * float(np.abs(d).max(initial=0)) ** 2 < 2.0**62:
        return (d * d).sum(1).tolist()
    exact = (d.astype(object) ** 2).sum(1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


RESULT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def whiten(df: DataFrame, model: dict[int, dict], errors: dict[int, float], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row and component: n, deviation, whitened, explained and identity_error."""
    rows = df.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sent = df.sparkSession.sparkContext.broadcast((model, errors))

    def run(batches):
        known, off = sent.value
        for own, dim, at, x in _blocks(batches, 1):
            m = known[dim]
            k = m["whiten"].shape[1]
            z = _centred(x, m["n"], m["sums"]) @ m["whiten"]
            each = np.repeat(np.arange(len(x)), k)
            yield batch(
                RESULT,
                own.column(0).take(pa.array(at[each])),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), m["n"])),
                pa.array(deviations(x, m["n"], m["sums"]), pa.int64()).take(pa.array(each)),
                pa.array(z.reshape(-1)),
                pa.array(np.tile(m["e"] / m["trace"] if m["trace"] else np.zeros(k), len(x))),
                pa.array(np.full(len(each), off[dim])),
            )

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
