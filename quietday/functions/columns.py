"""Column expressions: fills, transforms, index scales, safe statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 28 steps of the planetary index in thirds, and the linear amplitude of each.
KP_TO_AP = [0, 2, 3, 4, 5, 6, 7, 9, 12, 15, 18, 22, 27, 32, 39, 48, 56, 67, 80, 94, 111, 132, 154, 179, 207, 236, 300, 400]

#: From which value on a measure is missing.
FILLS = {"ap_index_nt": 999.0, "kp_index": 99.0, "f10_7_index_sfu": 999.9, "sunspot_number_r": 999.0, "dst_index_nt": 99999.0}

ROTATION_DAYS = 27


def r6(c: Column) -> Column:
    """Six decimals, without a negative zero: sums in another order then compare equal."""
    return F.round(c, 6) + F.lit(0.0)


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def mask_fill(c: Column, fill: float) -> Column:
    return F.when(c < fill, c.cast("double"))


def safe_log10(c: Column) -> Column:
    return F.when(c > 0, F.log10(c))


def recurrence_lag(lead: Column, rotation: int = ROTATION_DAYS, back: int | Column = 0) -> Column:
    """Days before the issue date of the analogue one or more rotations earlier; never negative."""
    return F.lit(rotation) * (F.ceil(lead / rotation) + back) - lead


def kp_to_ap(kp: Column, tolerance: float = 0.02) -> Column:
    """The amplitude of the nearest step; null off the grid by more than the tolerance."""
    step = F.rint(kp * 3)
    table = F.array(*[F.lit(float(v)) for v in KP_TO_AP])
    return F.when((F.abs(kp - step / 3) <= tolerance) & step.between(0, 27), F.get(table, step.cast("int")))


def signum_log(x: Column, mean: Column, std: Column, eps: Column, scale: Column) -> Column:
    scaled = x * scale
    return (F.signum(scaled) * F.log1p(F.abs(scaled)) - mean) / (std + eps)


def to_uint8(x: Column, low: float, high: float) -> Column:
    """Clipped to 0..255 and truncated."""
    return F.least(F.greatest((x - low) / (high - low) * 255.0, F.lit(0.0)), F.lit(255.0)).cast("int")


def gaussian_nll(mu: Column, log_var: Column, y: Column, clamp: float = 10.0) -> Column:
    s = F.least(F.greatest(log_var, F.lit(-clamp)), F.lit(clamp))
    return F.lit(0.5) * (s + F.pow(y - mu, 2) * F.exp(-s))


def safe_corr(a: str, b: str, least: int = 0) -> Column:
    """Pearson correlation over rows where both are present; null for a constant side or fewer rows than `least`."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    # a constant side may show a deviation of rounding size
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    cc = F.try_divide(F.covar_pop(x, y), sx * sy)
    return F.when((F.count(x) >= least) & (sx > 1e-12 * (1 + F.abs(F.avg(x)))) & (sy > 1e-12 * (1 + F.abs(F.avg(y)))), cc)


def contingency(y: str, yhat: str, threshold: float) -> dict[str, Column]:
    """pod, far, csi, n_events, n_forecast of the event value >= threshold on pairwise complete rows."""
    both = F.col(y).isNotNull() & F.col(yhat).isNotNull()
    obs, fc = F.col(y) >= threshold, F.col(yhat) >= threshold
    hits, misses, false = (F.count_if(both & x) for x in (obs & fc, obs & ~fc, ~obs & fc))
    return {
        "pod": F.try_divide(hits, hits + misses),
        "far": F.try_divide(false, hits + false),
        "csi": F.try_divide(hits, hits + misses + false),
        "n_events": hits + misses,
        "n_forecast": hits + false,
    }


def errors(y: str, yhat: str) -> dict[str, Column]:
    """n, mae, rmse, log_mae, corr on pairwise complete rows."""
    d = F.col(y) - F.col(yhat)
    return {
        "n": F.count(d),
        "mae": F.avg(F.abs(d)),
        "rmse": F.sqrt(F.avg(d * d)),
        "log_mae": F.avg(F.abs(F.log1p(F.col(y)) - F.log1p(F.col(yhat)))),
        "corr": safe_corr(y, yhat, 3),
    }


def score(y: str, yhat: str, threshold: float = 30.0) -> list[Column]:
    """The whole bundle of scores as aliased, rounded aggregates."""
    out = errors(y, yhat) | contingency(y, yhat, threshold)
    return [(c if k.startswith("n") else r6(c)).alias(k) for k, c in out.items()]
