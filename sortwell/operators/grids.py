"""Measures of values on grids and in bins, by relational operators: thresholds, spreads in windows, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sortwell.operators.components import connected_components
from sortwell.operators.match import same_join
from sortwell.session import settle


def two_class_threshold(bins: DataFrame, key: str, at: str = "bin", n: str = "n") -> DataFrame:
    """``key, threshold, below, above, between`` from counts ``n`` of whole bins ``at``.

    The threshold is the last bin of the lower of the two classes with the least variance within
    them, which is the most between them; of equal ones the first. All cuts of a key
    are read off running sums, so values are never compared again. ``between`` is that variance
    in squared bins. A key with one bin has no threshold; a null key is a key.
    """
    whole = Window.partitionBy(key)
    upto = whole.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    big = lambda c: c.cast("decimal(38,0)")
    sums = bins.groupBy(key, at).agg(F.sum(n).alias("_n")).withColumn("_x", F.col(at) * F.col("_n"))
    cuts = sums.select(key, at, F.sum("_n").over(upto).alias("_n0"), F.sum("_x").over(upto).alias("_s0"), F.sum("_n").over(whole).alias("_all"), F.sum("_x").over(whole).alias("_sum"))
    apart = (big(F.col("_s0").cast("decimal(19,0)") * F.col("_all").cast("decimal(18,0)")) - big(F.col("_sum").cast("decimal(19,0)") * F.col("_n0").cast("decimal(18,0)"))).cast("double")
    both = (F.col("_n0").cast("decimal(19,0)") * (F.col("_all") - F.col("_n0")).cast("decimal(18,0)")).cast("double")
    between = F.when(F.col("_n0") < F.col("_all"), apart * apart / both)
    best = cuts.withColumn("_b", between).groupBy(key, "_all").agg(F.max(F.when(F.col("_b").isNotNull(), F.struct("_b", (-F.col(at)).alias("_at"), "_n0"))).alias("m"))
    size = F.col("_all").cast("double")
    return best.select(key, (-F.col("m._at")).alias("threshold"), F.coalesce("m._n0", "_all").alias("below"), (F.col("_all") - F.coalesce("m._n0", "_all")).alias("above"), (F.col("m._b") / size / size).alias("between"))


def gridded(rows: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """``key, r, c, x``: an array as rows of ``width`` cells."""
    cells = rows.select(key, F.posexplode(values).alias("_p", "x"))
    return cells.select(key, F.floor(F.col("_p") / width).cast("int").alias("r"), (F.col("_p") % width).cast("int").alias("c"), "x")


def windowed_spread(cells: DataFrame, key: str, size: int, step: int, scale: float = 50.0, without: float = 0.5) -> DataFrame:
    """``key, windows, spread``: the mean deviation of square windows of a grid ``r, c, x`` of whole numbers, as a share of ``scale``.

    Windows of ``size`` begin every ``step`` cells, before the last place at which one
    would still fit. Running sums along rows and then along columns make a cell know
    the sum of all cells above and left of it; a window is four such cells, to which each cell
    is sent by arithmetic: one shuffle, whatever the windows' size. Grids have
    to be full. One without windows gets ``without``.
    """
    along = Window.partitionBy(key, "r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key, "c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    x = F.col("x").cast("long")
    summed = cells.select(key, "r", "c", F.sum(x).over(along).alias("s"), F.sum(x * x).over(along).alias("q"))
    summed = summed.select(key, "r", "c", F.sum("s").over(down).alias("s"), F.sum("q").over(down).alias("q"))
    shape = cells.groupBy(key).agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"))
    corner = lambda dr, dc, sign: F.struct((F.col("r") + dr).alias("r0"), (F.col("c") + dc).alias("c0"), F.lit(sign).alias("sign"))
    corners = F.array(*[corner(dr, dc, a * b) for dr, a in ((1 - size, 1), (1, -1)) for dc, b in ((1 - size, 1), (1, -1))])
    sent = summed.select(key, "s", "q", F.inline(corners)).where((F.col("r0") >= 0) & (F.col("c0") >= 0) & (F.col("r0") % step == 0) & (F.col("c0") % step == 0))
    fits = same_join(sent, shape, [key]).where((F.col("r0") < F.col("rows") - size) & (F.col("c0") < F.col("cols") - size))
    windows = fits.groupBy(key, "r0", "c0").agg(F.sum(F.col("sign") * F.col("s")).alias("s"), F.sum(F.col("sign") * F.col("q")).alias("q"))
    n = size * size
    deviation = F.sqrt((n * F.col("q") - F.col("s") * F.col("s")).cast("double")) / n
    found = windows.groupBy(key).agg(F.count(F.lit(1)).alias("windows"), F.avg(deviation).alias("_d"))
    spread = F.when(F.col("_d").isNull(), F.lit(without)).otherwise(F.least(F.lit(1.0), F.col("_d") / scale))
    return same_join(shape.select(key), found, [key], "left").select(key, F.coalesce("windows", F.lit(0)).alias("windows"), spread.alias("spread"))


def grid_components(cells: DataFrame, key: str, where: Column | str, least: int = 0) -> DataFrame:
    """``key, components, largest``: connected parts of more than ``least`` cells of a grid ``r, c`` that meet ``where``.

    Set cells that follow each other in a row are one interval, so a part has few nodes; intervals
    of neighbouring rows that touch, also at a corner, are linked, and the parts are
    the components of these links. A grid without such parts has 0 and 0.
    """
    along = Window.partitionBy(key, "r").orderBy("c")
    island = cells.where(where).withColumn("_i", F.col("c") - F.row_number().over(along))
    runs = settle(island.groupBy(F.col(key).alias("k"), "r", "_i").agg(F.min("c").alias("a"), F.max("c").alias("b")).select("k", "r", "a", "b"), "runs")
    node = F.struct("k", "r", "a")
    upper = runs.select(node.alias("u"), F.col("k").alias("k2"), (F.col("r") + 1).alias("r2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    touch = F.col("k").eqNullSafe(F.col("k2")) & (F.col("r") == F.col("r2")) & (F.col("a") <= F.col("b2") + 1) & (F.col("a2") <= F.col("b") + 1)
    parts = connected_components(runs.join(upper, touch).select(F.col("u").alias("a"), node.alias("b")))
    named = runs.withColumn("node", node).join(parts, "node", "left").select("k", F.coalesce("component", "node").alias("part"), (F.col("b") - F.col("a") + 1).alias("n"))
    sizes = named.groupBy("k", "part").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    per = sizes.groupBy(F.col("k").alias(key)).agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return same_join(cells.select(key).distinct(), per, [key], "left").select(key, zero("components"), zero("largest"))
