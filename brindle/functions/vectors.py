"""Vectors as arrays of floats: validity, dot product, length. Built-in expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def valid(embedding: Column | str, dimensions: int) -> Column:
    """Whether an embedding has exactly ``dimensions`` finite components that aren't all zero; false for
    a null one."""
    e = _column(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(e) == dimensions) & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in double precision, summed from the first component on."""
    pairs = F.zip_with(_column(a), _column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def literal(vector: list[float]) -> Column:
    """A vector that the driver knows, as a literal; an error if it is empty or not finite (K3)."""
    if not vector or not all(map(math.isfinite, vector)):
        raise ValueError("the query's vector must be finite and not empty")
    return F.array(*(F.lit(float(x)) for x in vector))


def l2_normalized(embedding: Column | str, dimensions: int, strict: bool = True) -> Column:
    """The first ``dimensions`` components scaled to length one, as doubles. A zero vector stays. A
    null or too short vector, one with a component that is null or not finite, and one whose length isn't
    finite or underflows to zero, is an error if ``strict``, else null."""
    cut = F.slice(_column(embedding), 1, dimensions)
    length = F.sqrt(dot(cut, cut))
    whole = F.coalesce((F.size(cut) == dimensions) & F.forall(cut, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    zero = F.forall(cut, lambda x: x == 0)
    usable = whole & (zero | ((length > 0) & (length < F.lit(float("inf")))))
    scaled = F.when(zero, F.transform(cut, lambda x: x.cast("double"))).otherwise(F.transform(cut, lambda x: x.cast("double") / length))
    wrong = F.raise_error(F.lit("the vector is too short, not finite, or too small to be normalised")).cast("array<double>") if strict else F.lit(None).cast("array<double>")
    return F.when(usable, scaled).otherwise(wrong)
