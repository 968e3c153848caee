"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X (n x d) stay in Spark.  Each step multiplies them by a right
vector and the result, which never leaves its task, by their transpose:

    u = X (v - beta u'), alpha = |u|,   w = X^T u / alpha - alpha v, beta = |w|

so X V = U B with B upper bidiagonal.  A left vector is kept as the combination
p of columns that gives it (u = X p), so its inner products with earlier ones
are those of p with X^T u, and both sides are fully reorthogonalised on d numbers.
The singular values of the small B are those of X, its right singular vectors
turn V into the components, and singular values squared over n are the
variances.  Steps end when B holds the leading components to double precision
and what isn't in B is too little to hide another one, or after d steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotquery.llm.common import stored

#: Entries are taken in steps of 1 / SCALE, counted from -OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
EPS = float(np.finfo(np.float64).eps)
#: What is left of a vector is rounding if it is this little, measured by all of X.
NOTHING = 1e-11
#: Largest magnitude of a scaled entry; greater ones are taken as this.
LARGEST = 1 << 62


def _rows(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int64).reshape(-1, dim)


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector without null or non-finite entries as scaled integers."""
    for batch in batches:
        lists = batch.column("vector")
        values = lists.flatten()
        size = np.diff(lists.offsets.to_numpy()) if not lists.null_count else np.array([len(v) if v is not None else 0 for v in lists.to_pylist()])
        entries = values.to_numpy(zero_copy_only=False).astype(np.float64)
        bad = ~np.isfinite(entries)  # a null comes as NaN
        if values.null_count:
            bad |= values.is_null().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(size)), size)
        good = np.bincount(owner, bad, minlength=len(size)) == 0
        good &= lists.is_valid().to_numpy(zero_copy_only=False)
        scaled = np.floor(SCALE * np.where(bad, 0, entries))
        whole = np.clip(scaled, -float(LARGEST), float(LARGEST)).astype(np.int64).tobytes()
        end = 8 * np.cumsum(size)
        keep = np.flatnonzero(good)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(keep)), pa.array(size[keep], pa.int32()),
             pa.array([whole[end[i] - 8 * size[i]:end[i]] for i in keep], pa.binary())], names=["id", "dim", "x"])


def _exact_sums(vectors: DataFrame, dim: int) -> list[int]:
    """Sum of each dimension, exactly: halves of 31 bits and the rest are summed."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, dim), np.int64)
        for batch in batches:
            x = _rows(batch, dim)
            total += [(x >> 31).sum(0), (x & 0x7FFFFFFF).sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(total[0]), pa.array(total[1])],
                                         names=["at", "high", "low"])
    found = (vectors.mapInArrow(each, "at int, high long, low long").groupBy("at")
             .agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).collect())
    sums = [0] * dim
    for row in found:
        sums[row["at"]] = int(row["high"]) * (1 << 31) + int(row["low"])
    return sums


class Centred:
    """The stored rows less their mean, and sums over them."""

    def __init__(self, vectors: DataFrame, dim: int, n: int, sums: list[int], reach: int) -> None:
        self.vectors, self.dim, self.n = vectors, dim, n
        self.mean = np.array([s / n for s in sums])
        #: n x - S fits a long, also squared and summed over the dimensions where ``squares`` says so
        self.whole = np.array(sums, np.int64) if 2 * n * reach < 1 << 62 else None
        self.squares = dim * (2 * n * reach) ** 2 < 1 << 62
        self.sums = sums

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x * self.n - self.whole) / self.n if self.whole is not None else x - self.mean

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row, exactly; None where it fits no long."""
        if self.squares:
            return ((x * self.n - self.whole) ** 2).sum(1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [e if e < 1 << 63 else None for e in exact]

    def total(self, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum of ``of(block)``, ``size`` numbers, over all blocks of centred rows:
        each task sums its blocks, Spark the tasks."""
        dim, centre = self.dim, self._centre()

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = np.zeros(size)
            for batch in batches:
                part += of(centre(_rows(batch, dim)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(part)], names=["at", "value"])
        out = np.zeros(size)
        for row in self.vectors.select("x").mapInArrow(each, "at int, value double").groupBy("at").agg(F.sum("value")).collect():
            out[row[0]] = row[1]
        return out

    def _centre(self) -> Callable[[np.ndarray], np.ndarray]:
        """``of`` without the DataFrame, to be sent to tasks."""
        bare = object.__new__(Centred)
        bare.__dict__ = {k: v for k, v in self.__dict__.items() if k != "vectors"}
        return bare.of


def bidiagonalise(product: Callable[[np.ndarray], tuple[np.ndarray, float]], dim: int, wanted: int,
                  energy: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` leading singular values of X (fewer if X is of lower rank)
    and right singular vectors (columns).  ``product(r)`` gives X^T X r and
    |X r|^2; ``energy`` is the sum of all squared entries of X.

    Steps begin in the row space of X, so no left vector is divided by next to
    nothing.  Where a step ends with nothing (all that its vector leads to is in
    B, as with equal singular values) another direction goes on, until none is left."""
    dice = np.random.default_rng(7)
    scale = np.sqrt(energy)
    right, left, images = np.zeros((dim, 0)), np.zeros((dim, 0)), np.zeros((dim, 0))
    alphas: list[float] = []
    betas: list[float] = []

    def apart(w: np.ndarray) -> np.ndarray:
        for _ in range(2):
            w = w - right @ (right.T @ w)
        return w

    def fresh() -> np.ndarray:
        """A direction of the row space that no right vector has; 0 if there is none."""
        z = apart(dice.standard_normal(dim))
        w = apart(product(z / np.linalg.norm(z))[0])
        return w if np.linalg.norm(w) > NOTHING * energy else np.zeros(dim)
    w = fresh()
    while w.any():
        v = w / np.linalg.norm(w)
        right = np.column_stack([right, v])
        r = v - betas[-1] * left[:, -1] if betas else v
        image, square = product(r)
        g = left.T @ image  # inner products with earlier left vectors
        r, image, square = r - left @ g, image - images @ g, square - g @ g
        alpha = float(np.sqrt(max(square, 0)))
        if alpha <= NOTHING * scale:
            alpha, r, image = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            r, image = r / alpha, image / alpha
        left, images = np.column_stack([left, r]), np.column_stack([images, image])
        alphas.append(alpha)
        k = len(alphas)
        w = apart(image - alpha * v)
        beta = float(np.linalg.norm(w))
        a, sigma, c = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        missing = energy - float(np.sum(sigma ** 2))
        if k == dim or k >= wanted and (np.abs(beta * a[-1, :wanted]) <= EPS * sigma[0]).all() and missing < sigma[wanted - 1] ** 2 / 2:
            break
        if beta <= NOTHING * scale:
            beta, w = 0.0, fresh()
        betas.append(beta)
    if not alphas:
        return np.zeros(0), np.zeros((dim, 0))
    vectors = right @ c[:wanted].T
    # either sign is right; the entry of greatest size is made positive
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return sigma[:wanted], vectors


def whiten(df: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """For each row with a whole vector and each of the ``components`` leading
    ones: ``key``, component (from 1, by falling variance e), n, deviation,
    whitened, explained and identity_error, as op11's contract has them.

    Entries c become floor(64 c) + 1,000,000 (beyond 2^62 in size: 2^62).  Rows go
    whose vector is null, holds null or non-finite entries, or has another
    length than most (of equally frequent lengths the greatest counts).
    Components whose e is below 2^-52 of the greatest are none: vectors of
    lower rank give fewer, equal vectors and empty tables no rows.  Repeated
    rows count and are returned as often as they come; null keys stay; other
    columns aren't read.  deviation is null where it fits no long."""
    spark = df.sparkSession
    id_type = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = stored(df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
                     .mapInArrow(_scaled, f"id {id_type}, dim int, x binary"), "vectors")
    sizes = vectors.groupBy("dim").count().filter("dim > 0").orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, n = sizes["dim"], sizes["count"]
    vectors = vectors.filter(F.col("dim") == dim)
    sums = _exact_sums(vectors, dim)
    rows = Centred(vectors, dim, n, sums, _reach(vectors, dim))

    energy = float(rows.total(lambda x: np.array([np.vdot(x, x)]), 1)[0])
    if energy == 0:
        return spark.createDataFrame([], schema)

    def product(r: np.ndarray) -> tuple[np.ndarray, float]:
        def of(x: np.ndarray) -> np.ndarray:
            u = x @ r
            return np.append(u @ x, u @ u)
        found = rows.total(of, dim + 1)
        return found[:-1], float(found[-1])
    sigma, axes = bidiagonalise(product, dim, min(components, dim), energy)
    real = sigma ** 2 > EPS * max(sigma, default=0) ** 2
    sigma, axes = sigma[real], axes[:, real]
    m, turn = len(sigma), axes / sigma * np.sqrt(n)

    def moments(x: np.ndarray) -> np.ndarray:
        w = x @ turn
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])
    found = rows.total(moments, m + m * m) / n
    error = float(np.abs(found[m:].reshape(m, m) - np.outer(found[:m], found[:m]) - np.eye(m)).max())
    explained = sigma ** 2 / energy
    bare = rows._centre().__self__

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch, dim)
            k = len(x)
            if not k:
                continue
            each = pa.array(np.repeat(np.arange(k), m))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)), pa.array(np.full(k * m, n)),
                 pa.array(bare.deviation(x), pa.int64()).take(each), pa.array((bare.of(x) @ turn).ravel()),
                 pa.array(np.tile(explained, k)), pa.array(np.full(k * m, error))],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return vectors.select("id", "x").mapInArrow(out, schema)


def _reach(vectors: DataFrame, dim: int) -> int:
    """The greatest size of an entry."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0
        for batch in batches:
            x = _rows(batch, dim)
            most = max(most, int(x.max(initial=0)), -int(x.min(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([most], pa.int64())], names=["most"])
    return vectors.mapInArrow(each, "most long").agg(F.max("most")).first()[0] + 1
