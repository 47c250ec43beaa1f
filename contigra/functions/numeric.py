"""Numeric functions over Columns: logistic, softmax, entropy, specificity, dense layers, argmax."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: float | Column) -> Column:
    """A DOUBLE: a decimal literal would round twice."""
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def logistic(x: Column, temperature: float = 1.0) -> Column:
    return number(1) / (number(1) + F.exp(-x / number(temperature)))


def softmax(parts: Sequence[Column], temperature: float = 1.0) -> list[Column]:
    """Softmax over columns, shifted by their greatest."""
    scaled = [x / number(temperature) for x in parts]
    most = F.greatest(*scaled) if len(scaled) > 1 else scaled[0]
    powers = [F.exp(x - most) for x in scaled]
    return [p / total(powers) for p in powers]


def entropy(parts: Sequence[Column]) -> Column:
    """Shannon entropy in bits of columns as weights; log2 of their number if all are 0."""
    n, whole = len(parts), total([number(x) for x in parts])
    share = [number(x) / whole for x in parts]
    bits = total([F.when(p > 0, -p * F.log2(p)).otherwise(number(0)) for p in share])
    return F.when(whole == 0, number(math.log2(n))).otherwise(bits)


def specificity(parts: Sequence[Column]) -> Column:
    """1 less entropy over its greatest value; 0 for one column or if all are 0."""
    if len(parts) == 1:
        return number(0)
    most = number(math.log2(len(parts)))
    return F.when(total([number(x) for x in parts]) == 0, number(0)).otherwise((most - entropy(parts)) / most)


def dense(x: Sequence[Column], kernel: Sequence[Sequence[float]], bias: Sequence[float]) -> list[Column]:
    """x @ kernel + bias, unrolled."""
    return [total([v * number(kernel[i][j]) for i, v in enumerate(x)]) + number(b) for j, b in enumerate(bias)]


def argmax(parts: Sequence[Column]) -> Column:
    """Index of the greatest column, from 0; ties to the lowest."""
    row = F.array(*parts)
    return (F.array_position(row, F.array_max(row)) - 1).cast("int")


def fixed(x: Column, places: int = 4) -> Column:
    """A number as text with so many places."""
    return F.format_string(f"%.{places}f", x)
