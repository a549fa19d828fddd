"""Column builders over float arrays, all in double precision on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..config import F32_EPSILON, HORIZONTAL_BLOCK, HORIZONTAL_SHARE, MIN_PARTIAL_D


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(a: str | Column) -> Column:
    return _col(a).cast("array<double>")


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: str | Column, b: str | Column) -> Column:
    """Squared Euclidean distance."""
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def prefix(a: str | Column, length: int | Column) -> Column:
    n = F.lit(length) if isinstance(length, int) else length
    return F.slice(_col(a), F.lit(1), F.least(n, F.size(_col(a))))


def l2_squared_prefix(a: str | Column, b: str | Column, length: int) -> Column:
    """Squared distance over the first `length` dimensions."""
    return l2_squared(prefix(a, length), prefix(b, length))


def dot(a: str | Column, b: str | Column) -> Column:
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm_squared(a: str | Column) -> Column:
    return F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x)


def norm_squared_prefix(a: str | Column, length: int) -> Column:
    return norm_squared(prefix(a, length))


def normalized(a: str | Column) -> Column:
    """The unit vector; a zero vector stays zero."""
    scale = F.greatest(F.sqrt(norm_squared(a)), F.lit(F32_EPSILON))
    return F.transform(doubles(a), lambda x: x / scale)


def next_multiple(x: Column, m: int) -> Column:
    """x rounded up to a multiple of m; m = 0 leaves it."""
    return x if m == 0 else (F.ceil(x / m) * m).cast("long")


def is_power_of_two(x: Column) -> Column:
    return (x > 0) & (x.bitwiseAND(x - 1) == 0)


def pruning_ratio(visited: Column, d: Column, epsilon: float) -> Column:
    """Share of the best distance that a partial distance over `visited` of d random dimensions may reach."""
    v = visited.cast("double")
    grown = v / d * F.pow(1 + epsilon / F.sqrt(v), F.lit(2.0))
    return F.when((visited == 0) | (visited == d), F.lit(1.0)).otherwise(grown)


def dimension_split(d: Column) -> tuple[Column, Column, Column]:
    """How dimensions are visited, as `rotation.Split` tells it: horizontal ones, vertical ones, and the prefix that a pruned search starts with."""
    share = F.when(d <= 256, 0.25).otherwise(HORIZONTAL_SHARE)
    whole = F.floor(F.floor(d * share) / HORIZONTAL_BLOCK + 0.5) * HORIZONTAL_BLOCK
    h = F.when(d <= HORIZONTAL_BLOCK, 0).when(whole >= d, HORIZONTAL_BLOCK).otherwise(whole).cast("int")
    v = (d - h).cast("int")
    return h, v, F.least(v, F.greatest(F.lit(MIN_PARTIAL_D), F.floor(v / 2).cast("int")))


def tuned_partial(partial: Column, not_pruned: Column, vertical: int, low: float = 0.03, high: float = 0.05, factor: float = 0.2) -> Column:
    """The next prefix, as `rotation.tuned_partial_d` tells it."""
    step = lambda f: F.greatest(F.lit(1), F.floor(partial * f).cast("int"))
    shorter = F.least(F.lit(vertical), F.greatest(F.lit(MIN_PARTIAL_D), partial - step(factor)))
    return F.when(not_pruned > high, F.least(F.lit(vertical), partial + step(factor * 2))).when(not_pruned < low, shorter).otherwise(partial).cast("int")


def register(spark: SparkSession) -> None:
    """Temporary SQL functions l2_squared, vector_dot, norm_squared and normalized_vector."""
    total = "aggregate({}, 0D, (s, x) -> s + x)"
    for name, args, body in (
        ("l2_squared", "a array<double>, b array<double>", total.format("zip_with(a, b, (x, y) -> (x - y) * (x - y))")),
        ("vector_dot", "a array<double>, b array<double>", total.format("zip_with(a, b, (x, y) -> x * y)")),
        ("norm_squared", "a array<double>", total.format("transform(a, x -> x * x)")),
    ):
        spark.sql(f"create or replace temporary function {name}({args}) returns double return {body}")
    scale = f"greatest(sqrt({total.format('transform(a, x -> x * x)')}), {F32_EPSILON}D)"
    spark.sql(f"create or replace temporary function normalized_vector(a array<double>) returns array<double> return transform(a, x -> x / {scale})")
