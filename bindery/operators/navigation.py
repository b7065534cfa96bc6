"""Navigation trees from lists of depths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _schema(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def clamp_depths(points: DataFrame, by: str = "pkg_id") -> DataFrame:
    """depth := min(depth, previous + 1), the first 0, a null one as the one before. The clamp hands
    on its result, so the points of one book, a bounded list, are walked once in order."""

    def clamped(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "depth"], kind="stable")
        out, last = [], -1
        for d in pdf["depth"].tolist():
            last = 0 if last < 0 else last if pd.isna(d) else min(max(int(d), 0), last + 1)
            out.append(last)
        return pdf.assign(depth=out)[[by, "ord", "depth"]]

    return points.select(by, "ord", "depth").groupBy(by).applyInPandas(clamped, _schema(points, by, "ord") + ", depth int")


def tree(points: DataFrame, by: str = "pkg_id") -> DataFrame:
    """by, ord, depth (clamped) -> parent, breadth-first number, and the end of the subtree.

    The parent is the last point before with one depth less; the subtree ends at the next point of
    the same depth or less. A book's points, a bounded list, are walked once: the last point of each
    depth is the parent of what follows, and an open point ends where one no deeper comes."""

    def placed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "depth"], kind="stable").reset_index(drop=True)
        n = len(pdf)
        parent, end, last, open_ = [None] * n, [None] * n, {}, []
        for k, (o, d) in enumerate(zip(pdf["ord"].tolist(), pdf["depth"].tolist())):
            parent[k] = last.get(d - 1)
            while open_ and open_[-1][0] >= d:
                end[open_.pop()[1]] = o
            last[d] = o
            open_.append((d, k))
        return pdf.assign(parent=pd.array(parent, "Int64"), subtree_end=pd.array(end, "Int64"))[[by, "ord", "depth", "parent", "subtree_end"]]

    kind = points.schema["ord"].dataType.simpleString()
    out = points.select(by, "ord", "depth").groupBy(by).applyInPandas(placed, _schema(points, by, "ord", "depth") + f", parent {kind}, subtree_end {kind}")
    return out.withColumn("bfs_no", F.row_number().over(Window.partitionBy(by).orderBy("depth", "ord")) - 1)


def first_inversion(rows: DataFrame, by: str, order: str, place: str) -> DataFrame:
    """The first row of each group whose place is before that of the row ahead of it."""
    w = Window.partitionBy(by).orderBy(order)
    bad = rows.withColumn("previous", F.lag(place).over(w)).where(F.col(place) < F.col("previous"))
    return bad.groupBy(by).agg(F.min_by(F.struct(order, place, "previous"), order).alias("x")).select(by, "x.*")


def reaches(items: DataFrame, good: DataFrame, by: str = "pkg_id") -> DataFrame:
    """items: by, id, next. Which ids reach a good one (by, id) in one step or more; cycles end a walk.

    An item has one next at most, so its walk is a path, and the item itself doesn't count. A package's
    map is bounded by its manifest; every item of it is walked over once, cycles as a whole."""

    def walked(pdf: pd.DataFrame) -> pd.DataFrame:
        goods = set(pdf.loc[pdf["good"], "id"])
        own = pdf[~pdf["good"]]
        nexts = dict(zip(own["id"], own["next"]))
        after: dict = {}  # whether a good one comes behind an id, the walk ending before the id itself
        whole: dict = {}  # whether the id or one behind it is good
        for start in nexts:
            path, at = [], {}
            x = start
            while x in nexts and x not in whole and x not in at:
                at[x] = len(path)
                path.append(x)
                x = nexts[x]
            if x in at:  # a new cycle
                ring = path[at[x] :]
                n = sum(y in goods for y in ring)
                for y in ring:
                    whole[y], after[y] = n > 0, n > (y in goods)
                path = path[: at[x]]
                known = n > 0
            else:
                known = whole.get(x, x in goods)
            for y in reversed(path):
                after[y] = known
                known = whole[y] = known or y in goods
        return own.assign(reaches=[after[x] for x in own["id"]])[[by, "id", "next", "reaches"]]

    rows = items.where("next is not null").select(by, "id", "next", F.lit(False).alias("good"))
    marks = good.select(by, "id").distinct().select(by, "id", F.lit(None).cast(items.schema["next"].dataType).alias("next"), F.lit(True).alias("good"))
    return rows.unionByName(marks).groupBy(by).applyInPandas(walked, _schema(items, by, "id", "next") + ", reaches boolean")
