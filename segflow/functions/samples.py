"""Arrays of audio samples, and class probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))


def peak_gain(top: Column, dbfs: float) -> Column:
    """Factor that brings a peak to ``dbfs``; silence is left as it is."""
    return F.when(top <= 1e-12, 1.0).otherwise(F.pow(F.lit(10.0), F.lit(dbfs / 20)) / top)


def apply_gain(samples: Column, gain: Column) -> Column:
    return F.transform(samples, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") * gain)))


def downmix(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a.cast("double") + b.cast("double")) / 2)


def crop_or_pad(samples: Column, n: int) -> Column:
    return F.slice(F.concat(samples.cast("array<double>"), F.array_repeat(F.lit(0.0), n)), 1, n)


def slice_samples(samples: Column, rate: int, start: Column, end: Column) -> Column:
    """Samples from ``start`` to ``end`` seconds, both rounded to a sample (halves to even) and clamped."""
    first = F.greatest(F.lit(0), F.least(F.bround(start * rate).cast("int"), F.size(samples)))
    last = F.greatest(first, F.least(F.bround(end * rate).cast("int"), F.size(samples)))
    return F.slice(samples, first + 1, last - first)


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / (F.sum(weight) + 1e-12)


def best_class(probabilities: dict[str, Column]) -> tuple[Column, Column]:
    """The class of the highest probability, the first of equal ones, and that probability."""
    values = F.array(*probabilities.values())
    names = F.array(*[F.lit(n) for n in probabilities])
    return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int")), F.array_max(values)
