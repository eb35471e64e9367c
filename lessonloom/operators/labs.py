"""Numeric kernels as column expressions: steps, activations, convolution, loss curves, confusion matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gradient_step(weight: Column, gradient: Column, rate: Column) -> Column:
    """weight - rate * gradient; null outside the allowed bounds."""
    inside = (F.abs(weight) <= 1e6) & (F.abs(gradient) <= 1e6) & rate.between(1e-6, 10.0)
    return F.when(inside, weight - rate * gradient)


def activation(name: str, x: Column) -> Column:
    return {"RELU": F.greatest(F.lit(0.0), x), "SIGMOID": 1 / (1 + F.exp(-x)), "TANH": F.tanh(x)}[name]


def curve(name: str, lo: float, hi: float, samples: int) -> Column:
    """``samples`` segments, so one point more, as array of (x, y)."""
    return F.transform(F.sequence(F.lit(0), F.lit(samples)), lambda i: F.struct((F.lit(lo) + F.lit(hi - lo) * i / F.lit(samples)).alias("x"), activation(name, F.lit(lo) + F.lit(hi - lo) * i / F.lit(samples)).alias("y")))


def convolve(matrix: Column, kernel: list[list[float]], stride: int = 1) -> Column:
    """Valid two-dimensional correlation of an array of arrays (the kernel isn't turned)."""
    kh, kw = len(kernel), len(kernel[0])

    def cell(r: Column, c: Column) -> Column:
        terms = [F.get(F.get(matrix, r + i), c + j) * F.lit(kernel[i][j]) for i in range(kh) for j in range(kw)]
        return sum(terms[1:], terms[0])

    rows, columns = F.sequence(F.lit(0), F.size(matrix) - kh, F.lit(stride)), F.sequence(F.lit(0), F.size(F.get(matrix, F.lit(0))) - kw, F.lit(stride))
    return F.transform(rows, lambda r: F.transform(columns, lambda c: cell(r, c)))


def first_overfit(train: Column, validation: Column) -> Column:
    """The first epoch, counted from 1, in which training loss falls while validation loss rises; null if none."""
    at = F.sequence(F.lit(1), F.size(train) - 1)
    hit = F.filter(at, lambda i: (F.get(train, i) < F.get(train, i - 1)) & (F.get(validation, i) > F.get(validation, i - 1)))
    return F.when(F.size(train) > 1, F.get(hit, F.lit(0)) + 1)


def confusion(pairs: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(accuracy, macro_recall) of labelled rows; a class without actual rows has recall 0."""
    cells = pairs.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    per = cells.groupBy(F.col(actual).alias("c")).agg(F.sum("n").alias("all"), F.sum(F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    seen = cells.select(F.col(actual).alias("c")).unionByName(cells.select(F.col(predicted).alias("c"))).distinct()
    full = seen.join(per, "c", "left").fillna(0)
    return full.agg((F.sum("hit") / F.sum("all")).alias("accuracy"), F.avg(F.when(F.col("all") > 0, F.col("hit") / F.col("all")).otherwise(0.0)).alias("macro_recall"))
