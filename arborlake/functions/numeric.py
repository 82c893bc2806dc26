"""Numeric functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def lit(x: float) -> Column:
    return F.lit(float(x))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(lit(low), F.least(lit(high), x))


def log_norm(x: Column, half: float) -> Column:
    """log2(1+x) as a share of log2(1+half), in [0, 1]; 0 where x or half is not positive (M1)."""
    if half <= 0:
        return lit(0)
    return F.when(x <= 0, lit(0)).otherwise(F.least(lit(1), F.log2(x + 1.0) / F.log2(lit(1 + half))))


def decay(days: Column, half_life: Column) -> Column:
    """exp(-0.693 d / h); 1 for no days, 0 for no half-life (M2)."""
    return F.when(days <= 0, lit(1)).when(half_life <= 0, lit(0)).otherwise(F.exp(-0.693 * days / F.nullif(half_life, lit(0))))


def inverse_log_norm(x: Column, half: float) -> Column:
    return 1.0 - log_norm(x, half)


def clamp_ratio(x: Column, low: float, high: float) -> Column:
    """Where x lies between low and high, in [0, 1]; 0 for an empty range (M3)."""
    return lit(0) if high <= low else clamp((x - low) / (high - low))


def log_norm_range(x: Column, ceiling: float, points: float) -> Column:
    return log_norm(x, ceiling) * points


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 (M7)."""
    return F.coalesce(F.try_divide(a, b), lit(0))


def harmonic(a: Column, b: Column) -> Column:
    return ratio(2.0 * a * b, a + b)


def cap_sum(parts: list[Column], cap: float) -> Column:
    """The sum of parts, at most cap (M6)."""
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return F.least(total, lit(cap))


def span_multiplier(days: Column) -> Column:
    """.7 under a day, 1.2 over two weeks, a line from .7 to 1 between (M8)."""
    return F.when(days < 1, lit(0.7)).when(days > 14, lit(1.2)).otherwise(0.7 + 0.3 * (days - 1) / 13)


def tier_confidence(tier: Column) -> Column:
    """Trust in a score by the deepest tier it has."""
    return F.when(tier == 2, lit(0.7)).when(tier == 3, lit(0.9)).otherwise(lit(0.3))


def sigma(confidence: Column) -> Column:
    """Standard deviation of a score, in heat points."""
    return F.greatest(10.0 * (1.0 - confidence), lit(1e-6))


# Hart's double-precision rational form of the normal distribution.
HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _poly(x: Column, terms: tuple[float, ...]) -> Column:
    out = lit(terms[0])
    for t in terms[1:]:
        out = out * x + t
    return out


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function to double precision (M4)."""
    a = F.least(F.abs(x), lit(37))
    bell = F.exp(-a * a / 2)
    near = bell * _poly(a, HART_TOP) / _poly(a, HART_BOTTOM)
    far = bell / (a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))) / 2.506628274631
    tail = F.when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def win_probability(mu_a: Column, mu_b: Column, sd_a: Column, sd_b: Column) -> Column:
    """P(a > b) of two normals; by comparison where the spread is nothing (M5)."""
    spread = F.hypot(sd_a, sd_b)
    sure = F.when(mu_a > mu_b, lit(1)).when(mu_a < mu_b, lit(0)).otherwise(lit(0.5))
    return F.when(spread < 1e-9, sure).otherwise(normal_cdf((mu_a - mu_b) / F.greatest(spread, lit(1e-9))))


def momentum_signal(stars: Column, forks: Column, days: Column) -> Column:
    """Growth on a log scale, 1 at twenty; 0 when nothing was observed."""
    grown = F.greatest(stars, F.lit(0)) + 2 * F.greatest(forks, F.lit(0))
    return F.when(days <= 0, lit(0)).otherwise(F.least(lit(1), F.log1p(grown.cast("double")) / F.log1p(lit(20))))


def sanitize_score(x: Column) -> Column:
    """A score in [0, 1]; NaN is 0."""
    return clamp(F.nanvl(x, lit(0)))


def days_between(later: Column, earlier: Column) -> Column:
    """Days with their fraction."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400_000_000.0


def midpoint_percentile(value: Column, by: list[str]) -> Column:
    """Share of the set below plus half the share of equals (A14); sets are told apart by ``by``."""
    below = F.rank().over(Window.partitionBy(*by).orderBy(value)) - 1
    equal = F.count("*").over(Window.partitionBy(*by, value))
    return (below + equal / 2.0) / F.count("*").over(Window.partitionBy(*by))
