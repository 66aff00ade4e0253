"""Vector and signal arithmetic on array columns (JVM side, double precision)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + 1e-9)


def scale_vec(a: Column, k: Column) -> Column:
    """``k`` must be a materialised column: it is read once per element."""
    return F.transform(a, lambda x: x * k)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def mean_square(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) / F.nullif(F.size(x), F.lit(0))


def level_dbfs(x: Column) -> Column:
    """RMS level; -80 dB for silence."""
    rms = F.sqrt(mean_square(x))
    return F.when(rms < 1e-9, -80.0).otherwise(20 * F.log10(rms))


def loudness_gain(x: Column, target_dbfs: float = -23.0) -> Column:
    rms = F.sqrt(mean_square(x))
    return F.when(rms < 1e-9, 1.0).otherwise(F.lit(10.0 ** (target_dbfs / 20)) / rms)


def clipping_ratio(x: Column, level: float = 0.999) -> Column:
    return F.size(F.filter(x, lambda v: F.abs(v.cast("double")) >= level)) / F.greatest(F.size(x), F.lit(1))


def frame_energies(x: Column, size: int) -> Column:
    """Mean square of each full frame."""
    n = F.floor(F.size(x) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: mean_square(F.slice(x, i * size + 1, F.lit(size))))).otherwise(
        F.array().cast("array<double>")
    )


def sorted_quantile(sorted_values: Column, q: float) -> Column:
    """Linear-interpolated quantile of a sorted array column."""
    pos = (F.size(sorted_values) - 1) * F.lit(q)
    lo, hi = F.floor(pos).cast("int"), F.ceil(pos).cast("int")
    a, b = F.get(sorted_values, lo), F.get(sorted_values, hi)
    return a + (b - a) * (pos - F.floor(pos))


def snr_db(energies: Column, floor_quantile: float = 0.1) -> Column:
    """Loudest frame against the quiet-frame quantile; ``energies`` from ``frame_energies``."""
    e = F.array_sort(energies)
    noise = sorted_quantile(e, floor_quantile)
    return F.when(F.size(energies) == 0, -80.0).when(noise < 1e-12, 60.0).otherwise(10 * F.log10(F.array_max(energies) / noise + 1e-9))


def bin_power(x: Column, n: int, freq: float, sample_rate: int) -> Column:
    """Squared magnitude of the DFT bin nearest ``freq`` for arrays of length ``n``."""
    import math

    k = int(0.5 + n * freq / sample_rate)
    if k > n // 2:
        return F.lit(0.0)
    cos = F.array(*[F.lit(math.cos(2 * math.pi * k * i / n)) for i in range(n)])
    sin = F.array(*[F.lit(math.sin(2 * math.pi * k * i / n)) for i in range(n)])
    return F.pow(dot(x, cos), F.lit(2)) + F.pow(dot(x, sin), F.lit(2))


def tone_share(x: Column, n: int, freqs: tuple[float, ...], sample_rate: int) -> Column:
    """Share of the energy in the bins of the given frequencies."""
    total = mean_square(x) * n + 1e-12
    power = sum((bin_power(x, n, f, sample_rate) for f in freqs), F.lit(0.0))
    return 2 * power / (n * total)


def fit_length(x: Column, n: int) -> Column:
    """Centre crop, or repeat to fill, to exactly ``n`` samples."""
    size = F.size(x)
    start = F.floor((size - n) / 2).cast("int") + 1
    reps = F.ceil(F.lit(n) / F.greatest(size, F.lit(1))).cast("int")
    return F.when(size >= n, F.slice(x, start, F.lit(n))).otherwise(F.slice(F.flatten(F.array_repeat(x, reps)), 1, n))


def cut_windows(x: Column, window: int, hop: int) -> Column:
    """Full windows of ``window`` samples every ``hop`` samples."""
    n = F.floor((F.size(x) - window) / hop).cast("int")
    return F.when(F.size(x) >= window, F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(x, i * hop + 1, F.lit(window))))
