"""Arrays and vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def once(value: Column, use) -> Column:
    """use(value) with the value computed once, though ``use`` reads it inside lambdas."""
    return F.transform(F.array(value), use)[0]


def unit(a: Column) -> Column:
    """L2-normalised; the zero vector stays."""
    both = F.struct(a.alias("v"), norm(a).alias("n"))
    return once(both, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(x.cast("double"))))


def max_sim(q: Column, d: Column) -> Column:
    """Late interaction: for each query token the best document token, averaged."""
    best = F.transform(q, lambda x: F.array_max(F.transform(d, lambda y: dot(x, y))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(q)


def blocks(a: Column, width: int) -> Column:
    """A vector cut into rows of ``width``: a list of token vectors."""
    return once(a, lambda v: F.transform(F.sequence(F.lit(0), (F.size(v) / width).cast("int") - 1), lambda i: F.slice(v, i * width + 1, width)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def yes_probability(yes: Column, no: Column) -> Column:
    """Softmax of two logits."""
    return 1 / (1 + F.exp(no - yes))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def pairs_of_neighbours(a: Column) -> Column:
    n = F.size(a)
    return F.zip_with(F.slice(a, 1, F.greatest(n - 1, F.lit(0))), F.slice(a, 2, F.greatest(n - 1, F.lit(0))), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
