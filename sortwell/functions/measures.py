"""Quality, complexity and likeness as column expressions over measures and gray levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sortwell.functions.vectors import bound, total


def content_type(score: Column, complete: Column, objects: Column, threshold: float = 0.6) -> Column:
    """``complex`` or ``simple``; null metrics count as 0.5, 0.5 and 0."""
    # fixed values: neutral metrics and cutoffs
    s, c, n = F.coalesce(score, F.lit(0.5)), F.coalesce(complete, F.lit(0.5)), F.coalesce(objects, F.lit(0))
    t = F.lit(float(threshold))
    return F.when(((s > t) & (c > 0.6) & (n >= 2)) | (s > t * 1.2), "complex").otherwise("simple")


def composite_score(sharpness: Column, brightness: Column, contrast: Column, noise: Column, pixels: Column, edges: Column, colors: Column, exposure: Column) -> Column:
    """The weighted quality of raw measures; each is brought to 0 to 1 first."""
    one = F.lit(1.0)
    # fixed values: weights and full scales
    return (
        0.25 * F.least(one, sharpness / 1000.0) + 0.15 * (one - F.abs(brightness - 127.0) / 127.0) + 0.15 * F.least(one, contrast / 80.0)
        + 0.15 * F.greatest(F.lit(0.0), one - noise / 10.0) + 0.10 * F.least(one, pixels / 12000000.0) + 0.10 * edges + 0.05 * colors + 0.05 * exposure
    )


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def spread(v: Column) -> Column:
    """The standard deviation of all elements."""
    return bound(mean(v), lambda m: F.sqrt(total(F.transform(v, lambda x: (x - m) * (x - m))) / F.size(v)))


def exposure(gray: Column) -> Column:
    """The share of middling gray levels less twice that of extreme ones, at least 0."""
    # fixed values: the levels that are middling and extreme
    share = lambda test: F.size(F.filter(gray, test))
    return F.greatest(F.lit(0.0), (share(lambda x: (x >= 50) & (x < 200)) - 2 * share(lambda x: (x < 10) | (x >= 245))) / F.size(gray))


def ssim(a: Column, b: Column) -> Column:
    """Structural similarity of two rasters of gray levels, taken over one window of all their pixels."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2  # fixed values
    pair = F.struct(mean(a).alias("a"), mean(b).alias("b"))

    def of(m: Column) -> Column:
        var = lambda v, k: total(F.transform(v, lambda x: (x - m[k]) * (x - m[k]))) / F.size(v)
        cov = total(F.zip_with(a, b, lambda x, y: (x - m["a"]) * (y - m["b"]))) / F.size(a)
        return (2 * m["a"] * m["b"] + c1) * (2 * cov + c2) / ((m["a"] * m["a"] + m["b"] * m["b"] + c1) * (var(a, "a") + var(b, "b") + c2))

    return bound(pair, of)


def fixed_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """The number of the equal-width bin from ``low`` to ``high`` that holds a value; the upper end belongs to the last bin, null outside."""
    place = F.floor((value - F.lit(float(low))) * bins / (high - low))
    return F.when((value >= low) & (value <= high), F.least(place, F.lit(bins - 1))).cast("int")


def merged_map(base: Column, over: Column) -> Column:
    """The entries of two maps, those of ``over`` winning; a null map adds nothing."""
    top = F.coalesce(over, F.map_filter(base, lambda k, v: F.lit(False)))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(top, k)), top)
