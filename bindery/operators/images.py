"""Page image analytics on tables of lines: runs, gutters, borders, histograms, order.

A page's lines are one group of bounded size (its height), so ordered windows stay within it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GUTTER_LIMIT = 100.0
BORDER_STEP = 20.0


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    return rows.withColumn("y", F.row_number().over(Window.partitionBy(by).orderBy(order)))


def runs(rows: DataFrame, by: str, y: str, flag: str) -> DataFrame:
    """Maximal runs of lines where flag holds: the difference of two counts is fixed within a run."""
    kept = rows.where(F.col(flag)).select(by, y)
    island = F.col(y) - F.row_number().over(Window.partitionBy(by).orderBy(y))
    return kept.withColumn("__island", island).groupBy(by, "__island").agg(F.min(y).alias("first_y"), F.max(y).alias("last_y"), F.count(F.lit(1)).alias("height")).drop("__island")


def strips(gutters: DataFrame, pages: DataFrame, by: str, least: int = 1) -> DataFrame:
    """What lies between gutters: pages has by, n (lines)."""
    edge = gutters.select(by, "first_y", "last_y").unionByName(pages.select(by, F.lit(0).alias("first_y"), F.lit(0).alias("last_y"))).unionByName(pages.select(by, (F.col("n") + 1).alias("first_y"), (F.col("n") + 1).alias("last_y")))
    nxt = F.lead("first_y").over(Window.partitionBy(by).orderBy("first_y"))
    cut = edge.withColumn("__next", nxt).where(F.col("__next").isNotNull())
    return cut.select(by, (F.col("last_y") + 1).alias("first_y"), (F.col("__next") - 1).alias("last_y")).where(F.col("last_y") - F.col("first_y") + 1 >= least)


def smoothed(rows: DataFrame, by: str, y: str, value: str) -> DataFrame:
    """Mean of five lines, cut off at the edges."""
    return rows.withColumn("mean", F.avg(value).over(Window.partitionBy(by).orderBy(y).rowsBetween(-2, 2)))


def best_gutter(rows: DataFrame, by: str, y: str, value: str, limit: float = GUTTER_LIMIT) -> DataFrame:
    mean = smoothed(rows, by, y, value).withColumn("mean", F.round("mean", 6))
    best = mean.groupBy(by).agg(F.min(F.struct("mean", y)).alias("b"))
    return best.where(F.col("b.mean") <= limit).select(by, F.col("b.mean").alias("best_mean"), F.col(f"b.{y}").alias("best_y"))


def borders(rows: DataFrame, by: str, y: str, value: str, step: float = BORDER_STEP) -> DataFrame:
    """Lines before the first that differs from the edge line; a border under a fiftieth isn't cropped."""
    edge = F.first(value).over(Window.partitionBy(by).orderBy(y))
    marked = rows.withColumn("__far", F.abs(F.col(value) - edge) > step)
    out = marked.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min(F.when(F.col("__far"), F.col(y))) - 1, F.lit(0)).alias("border"))
    return out.withColumn("cropped", F.col("border") * 50 >= F.col("n"))


def clip_points(pixels: DataFrame, by: str, luma: str, share: int = 200) -> DataFrame:
    """The first values at which a share of the pixels is reached from below and from above."""
    h = pixels.groupBy(by, luma).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by)
    c = h.withColumn("low", F.sum("n").over(w.orderBy(luma))).withColumn("total", F.sum("n").over(w))
    return c.groupBy(by).agg(F.min(F.when(F.col("low") * share >= F.col("total"), F.col(luma))).alias("low_clip"), F.max(F.when((F.col("total") - F.col("low") + F.col("n")) * share >= F.col("total"), F.col(luma))).alias("high_clip"), F.max("total").alias("pixels"))


def line_statistics(rows: DataFrame, by: str, value: str, ink: float = 50.0) -> DataFrame:
    return rows.groupBy(by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.var_pop(value), 4).alias("variance"), F.round(F.avg(F.when(F.col(value) > ink, 1.0).otherwise(0.0)), 6).alias("ink"))


def reading_order(panels: DataFrame, by: str, panel: str) -> DataFrame:
    """Places of panels in rows of five hundredths, from the left and from the right."""
    row, x = F.floor(F.col("y") / 5), F.floor("x")
    w = Window.partitionBy(by)
    return panels.select(by, panel, F.row_number().over(w.orderBy(row, x, panel)).alias("ltr"), F.row_number().over(w.orderBy(row, x.desc(), panel)).alias("rtl"))
