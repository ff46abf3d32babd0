"""Scalar expressions of the domain as Spark columns: everything here stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of genes whose expression follows the tumour rather than the copy number.
CANCER_GENES = (r"^MT-", r"^S100A6$", r"^B2M$", r"^HLA-B$", r"^TPT1$", r"^FTL$", r"^FTH1$", r"^RPL", r"^RPS")
#: Colour of each (major, minor) copy number.
PALETTE = {
    (0, 0): "darkblue", (1, 0): "lightblue", (1, 1): "lightgray", (2, 0): "dimgray", (2, 1): "lightgoldenrodyellow", (3, 0): "gold", (2, 2): "navajowhite", (3, 1): "orange",
    (4, 0): "darkorange", (3, 2): "salmon", (4, 1): "red", (5, 0): "darkred", (3, 3): "plum", (4, 2): "orchid", (5, 1): "purple", (6, 0): "indigo",
}
#: Least probability of a phase switch.
FLOOR = 1e-20


def lgamma(x: Column) -> Column:
    """Log gamma of x > 0: shifted by 8, then Stirling's series."""
    return lgamma_sum([x])


def lgamma_sum(plus: list[Column], minus: list[Column] = ()) -> Column:
    """Sum of the log gammas of ``plus`` less those of ``minus``.

    The series stands once, as a function of a bound variable: written out for each argument, the
    generated method would grow past what the JVM compiles.
    """

    def of(x: Column) -> Column:
        z = x + F.lit(8.0)
        shift = x
        for k in range(1, 8):
            shift = shift * (x + F.lit(float(k)))
        r2 = F.lit(1.0) / (z * z)
        series = (F.lit(1 / 12) - r2 * (F.lit(1 / 360) - r2 * (F.lit(1 / 1260) - r2 * (F.lit(1 / 1680) - r2 * F.lit(1 / 1188))))) / z
        return (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(shift)

    def total(xs: list[Column]) -> Column:
        return F.aggregate(F.array(*(x.cast("double") for x in xs)), F.lit(0.0), lambda s, x: s + of(x))

    return total(plus) - total(minus) if len(minus) else total(plus)


def digamma(x: Column) -> Column:
    """Derivative of log gamma at x > 0: shifted by 8, then its asymptotic series."""

    def of(x: Column) -> Column:
        r = F.lit(1.0) / (x + 8.0)
        r2 = r * r
        series = F.log(x + 8.0) - r / 2 - r2 * (F.lit(1 / 12) - r2 * (F.lit(1 / 120) - r2 * (F.lit(1 / 252) - r2 * (F.lit(1 / 240) - r2 * F.lit(1 / 132)))))
        return series - sum((F.lit(1.0) / (x + float(k)) for k in range(1, 8)), F.lit(1.0) / x)

    return F.transform(F.array(x.cast("double")), of)[0]


def trigamma(x: Column) -> Column:
    """Second derivative of log gamma at x > 0."""

    def of(x: Column) -> Column:
        r = F.lit(1.0) / (x + 8.0)
        r2 = r * r
        series = r + r2 / 2 + r * r2 * (F.lit(1 / 6) - r2 * (F.lit(1 / 30) - r2 * (F.lit(1 / 42) - r2 * (F.lit(1 / 30) - r2 * F.lit(5 / 66)))))
        return series + sum((F.lit(1.0) / ((x + float(k)) * (x + float(k))) for k in range(1, 8)), F.lit(1.0) / (x * x))

    return F.transform(F.array(x.cast("double")), of)[0]


def nb_params(mean: Column, std: Column) -> tuple[Column, Column]:
    """(n, p) of a negative binomial from its mean and standard deviation."""
    p = mean / (std * std)
    return mean * p / (1 - p), p


def nb_logpmf(k: Column, n: Column, p: Column) -> Column:
    """Negative binomial log-probability; 0 where a parameter is out of range."""
    ok = (p > 0) & (p < 1) & (n > 0) & (k >= 0)
    return F.when(ok, lgamma_sum([k + n], [n, k + 1.0]) + n * F.log(p) + k * F.log(1 - p)).otherwise(F.lit(0.0))


def bb_logpmf(k: Column, n: Column, a: Column, b: Column) -> Column:
    """Beta-binomial log-probability; 0 where a parameter is out of range."""
    ok = (a > 0) & (b > 0) & (n >= 0) & (k >= 0) & (k <= n)
    # The first three terms are log of n choose k, which no parameter enters.
    return F.when(ok, lgamma_sum([n + 1.0, k + a, n - k + b, a + b], [k + 1.0, n - k + 1.0, n + a + b, a, b])).otherwise(F.lit(0.0))


def bb_switched(original: Column, k: Column, n: Column, a: Column, b: Column) -> Column:
    """Log-probability under (b, a) from that under (a, b): four terms change."""
    return original + lgamma_sum([k + b, n - k + a], [k + a, n - k + b])


def nb_emission(count: Column, base: Column, log_mu: Column, alpha: Column, purity: Column | None = None) -> Column:
    """Log-probability of a count of which ``base`` are expected in diploid cells; 0 without base.

    ``purity`` mixes the state's expectation with the diploid one.
    """
    rate = F.exp(log_mu) if purity is None else purity * F.exp(log_mu) + 1 - purity
    grown = alpha * base * rate
    k, n = count.cast("double"), 1 / alpha
    # With variance mean + alpha mean^2 the parameters are 1 / alpha and 1 / (1 + alpha mean).
    found = lgamma_sum([k + n], [n, k + 1.0]) + k * F.log(grown) - (k + n) * F.log1p(grown)
    return F.when((base > 0) & (count >= 0), found).otherwise(F.lit(0.0))


def bb_emission(count: Column, depth: Column, p: Column, tau: Column, purity: Column | None = None) -> Column:
    """Log-probability of an allele count; 0 without depth."""
    share = p if purity is None else p * purity + F.lit(0.5) * (1 - purity)
    return F.when(depth > 0, bb_logpmf(count.cast("double"), depth.cast("double"), share * tau, (1 - share) * tau)).otherwise(F.lit(0.0))


def nb_state(count: Column, base: Column, log_mu: float, alpha: float, purity: Column | None = None) -> Column:
    """``nb_emission`` under one state's parameters: what no row enters is a literal."""
    rate = F.lit(math.exp(log_mu)) if purity is None else purity * F.lit(math.exp(log_mu) - 1) + 1.0
    k, n, grown = count.cast("double"), 1 / alpha, F.lit(alpha) * base * rate
    found = lgamma_sum([k + F.lit(n)], [k + 1.0]) - F.lit(math.lgamma(n)) + k * F.log(grown) - (k + F.lit(n)) * F.log1p(grown)
    return F.when((base > 0) & (count >= 0), found).otherwise(F.lit(0.0))


def bb_state(count: Column, depth: Column, p: float, tau: float, purity: Column | None = None) -> Column:
    """``bb_emission`` under one state's parameters."""
    k, n = count.cast("double"), depth.cast("double")
    if purity is None:
        a, b = p * tau, (1 - p) * tau
        own, fixed = [], F.lit(math.lgamma(tau) - math.lgamma(a) - math.lgamma(b))
        a, b = F.lit(a), F.lit(b)
    else:
        a = purity * F.lit((p - 0.5) * tau) + F.lit(0.5 * tau)
        b = F.lit(tau) - a
        own, fixed = [a, b], F.lit(math.lgamma(tau))
    found = lgamma_sum([n + 1.0, k + a, n - k + b], [k + 1.0, n - k + 1.0, n + F.lit(float(tau)), *own]) + fixed
    return F.when((depth > 0) & (count >= 0) & (count <= depth), found).otherwise(F.lit(0.0))


def digitize(x: Column, edges: list[float]) -> Column:
    """Number of edges below x (an edge belongs to the bucket under it)."""
    out = F.lit(0)
    for e in edges:
        out = out + (F.lit(float(e)) < x).cast("int")
    return out


def constant_longs(values: list[int]) -> Column:
    """A constant array of longs, however many, as one expression."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def rank_among(bounds: list[int], key: Column) -> Column:
    """How many of the ascending ``bounds`` lie below ``key``, by binary search."""
    if not bounds:
        return F.lit(0)
    steps, given = [1 << b for b in reversed(range(len(bounds).bit_length()))], constant_longs(bounds)
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(given, at + step - 1) < key), at + step).otherwise(at))


def logsumexp(xs: Column) -> Column:
    """log(sum(exp)) of an array of doubles."""
    top = F.array_max(xs)
    return top + F.log(F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def phase_switch_probability(distance_cm: Column, nu: float = 1.0) -> Column:
    """(1 - exp(-2 nu d)) / 2 and at least ``FLOOR``; null (another chromosome, no map) is the floor."""
    return F.coalesce(F.greatest((1 - F.exp(F.lit(-2 * nu) * distance_cm)) / 2, F.lit(FLOOR)), F.lit(FLOOR))


def log_site_transition(probability: Column, shift: float = -2.0) -> Column:
    """Log switch probability less the shift, one half at most."""
    return F.least(F.lit(math.log(0.5)), F.log(probability) - F.lit(shift))


def effective_elements(t: float, k: Column) -> Column:
    """Observations over which a chain with self-transition t among k states forgets its start; null for fewer than two states."""
    return F.when(k > 1, F.ceil(F.lit(2.0) / -F.log((F.lit(t) * k - 1) / (k - 1)))).cast("int")


def power_law_field(x: Column, y: Column, k: tuple[float, float], exponent: float, scale: float = 2.0) -> Column:
    """(s - scale * exponent) ** exponent of the position s along k; 0 before the front."""
    norm = math.hypot(*k)
    s = (x * F.lit(k[0] / norm)) + (y * F.lit(k[1] / norm))
    front = s - scale * exponent
    return F.when((s < 0) | (front < 0), F.lit(0.0)).otherwise(F.pow(front, F.lit(float(exponent))))


def is_cancer_gene(name: Column) -> Column:
    """Whether one of the gene patterns holds."""
    return name.rlike("|".join(CANCER_GENES))


def copy_colour(major: Column, minor: Column) -> Column:
    """Palette colour of an unordered pair of copies; null where it has none."""
    key = F.concat_ws(",", F.greatest(major, minor), F.least(major, minor))
    out = F.lit(None).cast("string")
    for (a, b), colour in PALETTE.items():
        out = F.when(key == f"{a},{b}", colour).otherwise(out)
    return out


def info_fields(info: Column) -> Column:
    """Columns ad, dp and oth of an INFO string, by position; a generator, so that a filter on them doesn't parse again."""
    parts = F.split(info, ";")
    held = (F.substring_index(parts[k], "=", -1).cast("long").alias(name) for k, name in enumerate(("ad", "dp", "oth")))
    return F.inline(F.array(F.struct(*held)))


def informative_snp(ad: Column, dp: Column, vaf: float = 0.1) -> Column:
    """Heterozygous at a fair share of reads, or homozygous with ten reads."""
    both = (ad >= 2) & (dp - ad >= 2) & (ad >= vaf * dp) & (ad <= (1 - vaf) * dp)
    return (dp > 0) & (both | ((dp >= 10) & ((ad == dp) | (ad == 0))))


def genotype(ad: Column, dp: Column) -> Column:
    """0/0, 0/1 or 1/1."""
    return F.when(ad == dp, "1/1").when((ad > 0) & (dp - ad > 0), "0/1").otherwise("0/0")


def phased_count(gt: Column, ad: Column, dp: Column) -> Column:
    """Reads of the second haplotype."""
    return F.when(gt == "0|1", ad).otherwise(dp - ad)


def ellipse_holds(x: Column, y: Column, cx: Column, cy: Column, l11: Column, l12: Column, l21: Column, l22: Column) -> Column:
    """Whether (x, y) lies in the unit disc pushed forward by L and moved to (cx, cy)."""
    det = l11 * l22 - l12 * l21
    u = (l22 * (x - cx) - l12 * (y - cy)) / det
    v = (l11 * (y - cy) - l21 * (x - cx)) / det
    return u * u + v * v <= 1


def ellipses_overlap(first: dict[str, Column], second: dict[str, Column], resolution: int = 1000) -> Column:
    """Whether a boundary point of either ellipse lies in the other (columns cx, cy, l11, l12, l21, l22)."""
    def inside(one: dict[str, Column], other: dict[str, Column]):
        def at(k: Column) -> Column:
            t = k * F.lit(2 * math.pi / resolution)
            x = one["cx"] + one["l11"] * F.cos(t) + one["l12"] * F.sin(t)
            y = one["cy"] + one["l21"] * F.cos(t) + one["l22"] * F.sin(t)
            return ellipse_holds(x, y, *(other[c] for c in ("cx", "cy", "l11", "l12", "l21", "l22")))

        return at

    steps = F.sequence(F.lit(0), F.lit(resolution - 1))
    return F.exists(steps, inside(first, second)) | F.exists(steps, inside(second, first))


def daughter(cx: Column, cy: Column, l: tuple[Column, Column, Column, Column], factor: float, u: Column, v: Column) -> tuple[Column, ...]:
    """(cx, cy, l11, l12, l21, l22) of an ellipse that grows out of another; u and v are uniform draws.

    Its size is ``factor`` plus up to 0.05, squared; it is moved along x and turned by up to an eighth of a circle.
    """
    size = F.lit(factor) + F.lit(0.05) * u
    return size - 1 + cx, cy, *(size * size * x for x in rotated(l, F.lit(math.pi / 4) * v))


def rotated(l: tuple[Column, Column, Column, Column], theta: Column) -> tuple[Column, Column, Column, Column]:
    """Rotation by theta times L (l11, l12, l21, l22)."""
    c, s = F.cos(theta), F.sin(theta)
    return c * l[0] - s * l[2], c * l[1] - s * l[3], s * l[0] + c * l[2], s * l[1] + c * l[3]
