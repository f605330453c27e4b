"""Embedding whitening from the exact characteristic polynomial of the integer scatter.

Entries become integers `x = floor(256 c)`. The fit list has each distinct vector once; its sums
and products are added exactly (`moments`), which gives the integer scatter `n * sum(x x') - S S'`,
that is n^2 times the covariance. Its characteristic polynomial is found modulo many primes, each
by a Hessenberg reduction in a Spark task, and put together by Chinese remainders beyond a bound
of all coefficients. The roots are real, so the sign changes of the polynomial shifted to a point
count the roots above it exactly; bisection isolates each wanted one to `ROOT_BITS` bits. Inverse
iteration in long decimals finds an orthonormal basis of its null space. Rows are then projected
in tasks that know the few components.

Only figures of the size of the dimension squared reach the driver.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite entry are dropped;
if lengths differ, rows of the most frequent one among distinct vectors (the longer of a tie)
stay; repeated vectors count once in the fit and keep all their rows; a root of zero has no
component, so data of a lower rank return fewer rows, equal vectors only and an empty table none;
roots equal in all `ROOT_BITS` bits share a basis in a fixed order; a deviation beyond a long is
null; a row without a vec_id stays; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeaudit.storage import materialize

SCALE = 256
COMPONENTS = 4
ROOT_BITS = 110
LIMB = 32  # bits of the parts in which exact sums are added up
STEPS = 3  # of inverse iteration
_EXACT = 1 << 53  # up to which doubles hold integers


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """`(vec_id, x)` of the rows whose vector has finite entries only."""
    c = F.col("embedding")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    kept = embeddings.where(c.isNotNull() & (F.size(c) > 0) & ~bad)
    return kept.select(F.col("vec_id").cast("long"), F.transform(c, lambda v: F.floor(v.cast("double") * SCALE).cast("long")).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def _products(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers; products are exact in doubles, in parts of 21 bits where they must be."""
    top = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    rows = len(x)
    if top * top * max(rows, 1) < _EXACT:
        wide = x.astype(np.float64)
        return (wide.T @ wide).astype(np.int64).astype(object)
    out = np.zeros((x.shape[1], x.shape[1]), object)
    for lo in range(0, rows, 256):
        part = x[lo : lo + 256]
        limbs = [(part & 0x1FFFFF), (part >> 21) & 0x1FFFFF, part >> 42]
        limbs = [v.astype(np.float64) for v in limbs]
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                out += (a.T @ b).astype(np.int64).astype(object) * (1 << 21 * (i + j))
    return out


def moments(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """Number, sums and products of the integer vectors `x`, exactly."""
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), d)
                n += len(x)
                low, high = x & 0xFFFFFFFF, x >> 32
                sums += low.sum(axis=0).astype(object) + high.sum(axis=0).astype(object) * (1 << 32)
                products += _products(x)
        if n:
            rows = [[], [], []]
            for entry, value in enumerate([n, *sums, *products[upper]]):
                sign, rest, limb = (-1 if value < 0 else 1), abs(int(value)), 0
                while rest:
                    for column, v in zip(rows, (entry, limb, sign * (rest & ((1 << LIMB) - 1)))):
                        column.append(v)
                    rest, limb = rest >> LIMB, limb + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["entry", "limb", "v"])

    rows = fit.select("x").mapInArrow(run, "entry long, limb long, v long").groupBy("entry", "limb").agg(F.sum("v").alias("v"))
    flat = [0] * (1 + d + len(upper[0]))
    for entry, limb, v in rows.collect():  # (d + 1) (d + 2) / 2 entries
        flat[entry] += v << (LIMB * limb)
    gram = [[0] * d for _ in range(d)]
    for i, j, v in zip(*(u.tolist() for u in upper), flat[1 + d :]):
        gram[i][j] = gram[j][i] = v
    return flat[0], flat[1 : 1 + d], gram


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all numbers below 3 * 10^9."""
    if n % 2 == 0:
        return n == 2
    twos = ((n - 1) & -(n - 1)).bit_length() - 1
    for base in (2, 3, 5, 7):
        x = pow(base, (n - 1) >> twos, n)
        if base % n and x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return n > 1


def primes(bits: int) -> list[int]:
    """Primes below 2^31, from above, whose product has over `bits` bits."""
    out, product, n = [], 1, (1 << 31) - 1
    while product.bit_length() <= bits:
        if _is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, the constant first, of the monic characteristic polynomial modulo a prime."""
    h, d = matrix.copy(), len(matrix)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        if below[0]:
            i = k + below[0]
            h[[k, i]] = h[[i, k]]
            h[:, [k, i]] = h[:, [i, k]]
        factors = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - factors[:, None] * h[k] % p) % p
        # Columns undo the row steps, so that the matrix stays similar.
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * factors % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - h[k - 1, k - 1] * polys[k - 1]) % p
        path = 1
        for i in range(k - 1, 0, -1):
            path = path * int(h[i, i - 1]) % p
            if not path:
                break
            polys[k] = (polys[k] - polys[i - 1] * (int(h[i - 1, k - 1]) * path % p)) % p
    return polys[d]


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, the constant first, for a positive semidefinite integer matrix.

    The sizes of the coefficients add up to the product of (1 + root), at most (1 + trace / d)^d.
    """
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    bits = d * (trace // d + 2).bit_length() + 2
    chosen = primes(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                p = chosen[k]
                found = polynomial_mod(np.array([[v % p for v in row] for row in matrix], np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([found.tolist()], pa.list_(pa.int64()))], ["k", "residues"])

    tasks = min(len(chosen), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.range(0, len(chosen), 1, tasks).mapInArrow(run, "k long, residues array<long>").collect()
    product = 1
    for p in chosen:
        product *= p
    total = [0] * (d + 1)
    for k, residues in rows:
        p = chosen[k]
        rest = product // p
        unit = rest * pow(rest, -1, p)
        for i, r in enumerate(residues):
            total[i] += r * unit
    total = [t % product for t in total]
    return [t - product if 2 * t > product else t for t in total]


def roots_above(poly: list[int], a: int, s: int) -> int:
    """How many roots exceed a / 2^s, for a polynomial with real roots only: sign changes after the shift."""
    d = len(poly) - 1
    if s > 0:
        shifted = [c << (s * (d - i)) for i, c in enumerate(poly)]
    else:
        shifted, a = list(poly), a << -s
    for k in range(d):
        for i in range(d - 1, k - 1, -1):
            shifted[i] += a * shifted[i + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def isolate(poly: list[int], j: int, bits: int = ROOT_BITS) -> tuple[int, int, int, int]:
    """`(a, s, place, size)`: the j-th largest root, which is above zero, lies in (a, a + 1] / 2^s with
    `bits` bits; it is number `place` from 0 of the `size` roots in there."""
    a, s = 0, -(poly[-2].bit_length() + 1)  # no root is above the trace
    while a.bit_length() < bits:
        a, s = 2 * a, s + 1
        if roots_above(poly, a + 1, s) >= j:
            a += 1
    over = roots_above(poly, a + 1, s)
    return a, s, j - 1 - over, roots_above(poly, a, s) - over


def null_vectors(matrix: list[list[int]], a: int, s: int, size: int) -> list[list[float]]:
    """An orthonormal basis of the space of the `size` eigenvalues in (a, a + 1] / 2^s."""
    d = len(matrix)
    digits = 60 + ROOT_BITS // 2 + len(str(max(abs(v) for row in matrix for v in row)))
    with localcontext(Context(prec=digits)):
        at = Decimal(2 * a + 1) / Decimal(2) ** (s + 1)
        lu = np.array([[Decimal(v) for v in row] for row in matrix], object)
        for i in range(d):
            lu[i, i] -= at
        order = np.arange(d)
        tiny = at * Decimal(10) ** -(digits - 5)
        for k in range(d):
            i = k + int(np.argmax([abs(v) for v in lu[k:, k]]))
            lu[[k, i]], order[[k, i]] = lu[[i, k]], order[[i, k]]
            if lu[k, k] == 0:
                lu[k, k] = tiny
            lu[k + 1 :, k] = lu[k + 1 :, k] / lu[k, k]
            lu[k + 1 :, k + 1 :] -= np.outer(lu[k + 1 :, k], lu[k, k + 1 :])
        # A fixed start without structure: the same basis in every task and run.
        rng = np.random.default_rng(12)
        basis = [np.array([Decimal(int(v)) for v in rng.integers(-1000, 1000, d)], object) for _ in range(size)]
        for _ in range(STEPS):
            for m, v in enumerate(basis):
                v = v[order]
                for k in range(1, d):
                    v[k] -= lu[k, :k] @ v[:k]
                for k in range(d - 1, -1, -1):
                    v[k] = (v[k] - (lu[k, k + 1 :] @ v[k + 1 :] if k + 1 < d else 0)) / lu[k, k]
                v = v / max(abs(e) for e in v)
                for _ in range(2):
                    for u in basis[:m]:
                        v = v - (u @ v) * u
                basis[m] = v / (v @ v).sqrt()
        return [[float(e) for e in v] for v in basis]


def components(spark, matrix: list[list[int]], count: int) -> list[tuple[float, float, list[float]]]:
    """`(root, share of the trace, unit vector)` of the largest `count` positive roots, one task for each."""
    poly = characteristic_polynomial(spark, matrix)
    rank = len(matrix) - next(i for i, c in enumerate(poly) if c)
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    wanted = min(count, rank)
    if not wanted:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in batch.column("id").to_pylist():
                a, s, place, size = isolate(poly, j)
                with localcontext(Context(prec=60)):
                    root = Decimal(2 * a + 1) / Decimal(2) ** (s + 1)
                    values = [float(root), float(root / Decimal(trace))]
                values += null_vectors(matrix, a, s, size)[place]
                yield pa.RecordBatch.from_arrays([pa.array([j], pa.int64()), pa.array([values], pa.list_(pa.float64()))], ["j", "found"])

    rows = spark.range(1, wanted + 1, 1, wanted).mapInArrow(run, "j long, found array<double>").orderBy("j").collect()
    return [(r.found[0], r.found[1], r.found[2:]) for r in rows]


def _project(rows: DataFrame, keys: list[str], n: int, sums: list[int], found: list[tuple]) -> DataFrame:
    """Rows with `deviation` and `z`, the whitened values by component."""
    d = len(sums)
    axes = np.array([v for _, _, v in found]).T / np.sqrt([root for root, *_ in found])
    kinds = dict(rows.dtypes)
    most = (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            top = max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, sums)) if len(x) else 0
            big = top * top * d > most
            off = x.astype(object) * n - np.array(sums, object) if big else x * n - np.array(sums, np.int64)
            far = [v if v <= most else None for v in (off * off).sum(axis=1).tolist()]
            wide = off.astype(np.float64)
            # Row by row sums, so that equal vectors get equal values in every task.
            z = np.stack([(wide * axis).sum(axis=1) for axis in axes.T], axis=1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(far, pa.int64()), flat], [*keys, "deviation", "z"])

    return rows.select(*keys, "x").mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "deviation long", "z array<double>"]))


def whiten(embeddings: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """Per row and component `(vec_id, component, n, deviation, whitened, explained, identity_error)`."""
    spark = embeddings.sparkSession
    rows = integer_vectors(embeddings)
    fit = materialize(rows.select("x").distinct(), "whitening-fit")
    length = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    found = []
    if length:
        d = length.d
        fit, rows = (t.where(F.size("x") == d) for t in (fit, rows))
        n, sums, gram = moments(fit, d)
        scatter = [[n * gram[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
        found = components(spark, scatter, count)
    if not found:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    z = [F.col("z")[k] for k in range(len(found))]
    pairs = [(i, j) for i in range(len(z)) for j in range(i + 1)]
    again = _project(fit, [], n, sums, found).agg(*[F.covar_pop(z[i], z[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(again[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    shares = F.array(*[F.lit(share) for _, share, _ in found])
    return _project(rows, ["vec_id"], n, sums, found).select("vec_id", "deviation", F.posexplode("z").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("k") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"))
