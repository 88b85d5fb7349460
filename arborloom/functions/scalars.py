"""Scalar functions as Column expressions (F02-F18 of the blueprint) and plain twins used by kernels."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def log_add(x: Column, y: Column) -> Column:
    """log10 of the sum of two numbers given as log10; null stands for 0; a gap over 20 is ignored."""
    hi, lo = F.greatest(x, y), F.least(x, y)
    both = F.when(hi - lo > 20, hi).otherwise(hi + F.log10(1 + F.pow(F.lit(10.0), lo - hi)))
    return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(both)


def log_mask(flag: Column) -> Column:
    """true is log 1, false impossible (null)."""
    return F.when(flag, F.lit(0.0))


def inverse_gap(x: Column, least: Column, most: Column, limit: float) -> Column:
    """(max - min) / 3 / (max - x + 1) * limit."""
    return (most - least) / 3 / (most - x + 1) * limit


def file_label(x: Column) -> Column:
    """a number as a file-safe label: the point becomes p, trailing zeros are cut."""
    text = F.regexp_replace(F.format_string("%.6f", x.cast("double")), "\\.?0+$", "")
    return F.replace(text, F.lit("."), F.lit("p"))


def range_values(text: str) -> list[float]:
    """``v``, ``a:b`` or ``a:step:b`` (ends included), whole numbers or reals."""
    parts = [float(x) for x in text.split(":")]
    if len(parts) == 1:
        return parts
    a, step, b = (parts[0], 1.0, parts[1]) if len(parts) == 2 else parts
    return [a + i * step for i in range(int(math.floor((b - a) / step + 1e-9)) + 1)]


def deepest(stack: Column) -> Column:
    """index of the last filled slot before the first empty (0) one; -1 when the first is empty."""
    zero = F.array_position(stack, 0)
    return F.when(zero == 0, F.size(stack)).otherwise(zero).cast("int") - F.when(zero == 0, 1).otherwise(2)


def first_non_negative(values: Column) -> Column:
    """index of the first value that is not negative, -1 if there is none."""
    return F.array_position(F.transform(values, lambda v: (v >= 0).cast("int")), 1).cast("int") - 1


def bracket_tag(tag: Column) -> Column:
    """whether a tag stands for a left or right bracket."""
    return tag.rlike("^-?[LR](R|S|C)B-?$")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function over a whole array: Stirling's series from 8 on, the recurrence below; NaN for 0 and less."""
    x = np.asarray(x, float)
    with np.errstate(all="ignore"):
        y = np.where(x > 0, x, np.nan)
        shift = np.zeros_like(y)
        for _ in range(8):
            low = y < 8
            shift = np.where(low, shift + np.log(np.where(low, y, 1.0)), shift)
            y = np.where(low, y + 1, y)
        z = 1 / (y * y)
        series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * 691 / 360360))))) / y
        return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def lgamma(x: Column) -> Column:
    """Natural log of the gamma function (F05), null for null and for 0 and less; SQL has none, so Arrow batches go through ``log_gamma``."""

    def f(a: pa.Array) -> pa.Array:
        return pa.array(log_gamma(a.to_numpy(zero_copy_only=False)), from_pandas=True)

    return F.arrow_udf(f, "double")(x.cast("double"))


def normalised_from_log(logs: Column) -> Column:
    """an array of log10 values as probabilities that sum to 1; null entries are 0."""
    raised = F.transform(logs, lambda v: F.coalesce(F.pow(F.lit(10.0), v - F.array_max(logs)), F.lit(0.0)))
    total = F.aggregate(raised, F.lit(0.0), lambda a, v: a + v)
    return F.transform(raised, lambda v: v / total)


def as_log(p: Column) -> Column:
    """log10, null for 0."""
    return F.when(p > 0, F.log10(p))


def from_log(x: Column) -> Column:
    """The reverse."""
    return F.when(x.isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(10.0), x))


def normal_log_density(x: Column, mean: Column, sd: Column) -> Column:
    """Natural log of the normal density."""
    z = (x - mean) / sd
    return -0.5 * z * z - F.ln(sd) - 0.5 * math.log(2 * math.pi)


def harmonic(p: Column, r: Column) -> Column:
    """F score, 0 if either is 0."""
    return F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def annealing(iteration: Column, length: int, initial: float, final: float, phases: int) -> Column:
    """Stepwise schedule; the whole length and beyond give 1 at the end of the run."""
    phase = F.floor(iteration / (length // phases))
    return F.when(iteration >= length, F.lit(1.0)).otherwise(initial + phase * ((final - initial) / phases))


def dirichlet_constant(counts: Column, alpha: float) -> Column:
    """sum of ln gamma(c + alpha) less ln gamma of the sum, of an array of counts; null for a null array, 0 for an empty one."""

    def f(arrays: pa.Array) -> pa.Array:
        flat = arrays.flatten().to_numpy(zero_copy_only=False) + alpha
        row = pc.list_parent_indices(arrays).to_numpy(zero_copy_only=False)
        logs = np.bincount(row, weights=log_gamma(flat), minlength=len(arrays))
        total = np.bincount(row, weights=flat, minlength=len(arrays))
        out = np.where(total > 0, logs - log_gamma(np.where(total > 0, total, 1.0)), 0.0)
        return pa.array(out, mask=arrays.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(f, "double")(counts.cast("array<double>"))


def tempered(p: Column, temperature: float) -> Column:
    """an array of probabilities to the power 1 / T, normalised."""
    raised = F.transform(p, lambda x: F.pow(x, F.lit(1.0 / temperature)))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def uniforms(keys: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys, one each, the same for the same key and stream: counter-based, so no generator is made for a row."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((stream + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def normals(keys: np.ndarray, stream: int) -> np.ndarray:
    """Standard normal numbers from keys (Box and Muller)."""
    return np.sqrt(-2 * np.log(uniforms(keys, 2 * stream))) * np.cos(2 * math.pi * uniforms(keys, 2 * stream + 1))


def gammas(keys: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Gamma numbers of scale 1 from keys, whole arrays at a time (Marsaglia and Tsang's rejection; shapes below 1 are raised by 1 and scaled back)."""
    shape = np.asarray(shape, float)
    small = shape < 1
    d = np.where(small, shape + 1, shape) - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out, left, turn = np.empty(len(shape)), np.arange(len(shape)), 1
    while len(left):
        x = normals(keys[left], 3 * turn)
        v = (1 + c[left] * x) ** 3
        u = uniforms(keys[left], 6 * turn + 5)
        with np.errstate(all="ignore"):
            ok = (v > 0) & (np.log(u) < 0.5 * x * x + d[left] * (1 - v + np.log(v)))
        out[left[ok]] = d[left[ok]] * v[ok]
        left, turn = left[~ok], turn + 1
    with np.errstate(all="ignore"):
        return np.where(small, out * uniforms(keys, 0) ** (1 / shape), out)
