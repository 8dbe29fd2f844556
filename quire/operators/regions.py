"""Joins of boxes on pages: boxes of a page meet at once where they are few, else a grid deals them to cells and they meet in those."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGES = ["x0", "y0", "x1", "y1"]
#: Side of a cell, in pages: a box of a column's width meets four or five cells a row.
CELL = 1 / 8
#: Boxes of a page, on both sides, that meet in one cell: a copy for each cell of a grid would cost more than their pairs.
FEW = 256


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def shared(a: Column, b: Column) -> Column:
    """The area that two boxes have in common."""
    side = lambda low, high: F.greatest(F.lit(0.0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]))
    return side("x0", "x1") * side("y0", "y1")


def overlapping(left: DataFrame, right: DataFrame, by: list[str], threshold: float, of: str = "left", cell: float = CELL, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of boxes on one page whose shared area is at least ``threshold`` (above 0) of the left box's, or of the smaller one's.

    Both sides: the columns ``by``, ``id`` and the edges x0, y0, x1, y1, the right one also ``keep``; the result: by, left, right
    (structs of id, edges and what is kept) and ratio. A page of FEW boxes is one cell. On fuller pages a box is dealt to the cells
    that it reaches, edges beyond the page counting as at its rim, and a pair is formed in one cell, that of the first corner of
    what they share: no pair is formed that shares no cell, none is formed twice, and a page with many boxes is many groups.
    Boxes with a null edge or one that is no number meet none; neither do boxes turned inside out. Rows that are alike count each.
    """
    if not threshold > 0 or of not in ("left", "smaller"):
        raise ValueError("the threshold must be above 0, and of left or smaller")
    at = lambda c: F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) / cell)

    # at most a page for each FEW boxes
    full = left.select(*by).unionByName(right.select(*by)).groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > FEW).select(*by, F.lit(True).alias("_full"))

    def dealt(df: DataFrame, name: str, *more: str) -> DataFrame:
        whole = df.where(" and ".join(f"{e} is not null and not isnan({e})" for e in EDGES) + " and x0 < x1 and y0 < y1")
        box = F.struct("id", *(F.col(e).cast("double").alias(e) for e in EDGES), *more).alias(name)
        whole = whole.join(F.broadcast(full), by, "left").withColumn("_full", F.col("_full").isNotNull())
        cells = lambda low, high: F.explode(F.when(F.col("_full"), F.sequence(at(F.col(low)), at(F.col(high)))).otherwise(F.array(F.lit(0).cast("long"))))
        rows = whole.select(*by, "_full", box, cells("x0", "x1").alias("_x"), "y0", "y1")
        return rows.select(*by, "_full", name, "_x", cells("y0", "y1").alias("_y"))

    met = dealt(left, "left").join(dealt(right, "right", *keep).drop("_full"), [*by, "_x", "_y"])
    a, b = F.col("left"), F.col("right")
    own = ~F.col("_full") | ((F.col("_x") == at(F.greatest(a["x0"], b["x0"]))) & (F.col("_y") == at(F.greatest(a["y0"], b["y0"]))))
    base = area(a) if of == "left" else F.least(area(a), area(b))
    return met.where(own).withColumn("ratio", shared(a, b) / F.greatest(base, F.lit(1e-9))).where(F.col("ratio") >= threshold).drop("_x", "_y", "_full")


def matches(boxes: DataFrame, regions: DataFrame, by: list[str], kinds: dict[str, tuple[Callable[[Column], Column], float]], keep: tuple[str, ...] = ()) -> DataFrame:
    """The boxes, each row once, with a column for each of ``kinds``: the smallest id of the regions for which its condition (on a
    struct of the region's id, edges and ``keep``) holds and which cover its share of the box, or null. All kinds take one join."""
    pairs, b = overlapping(boxes, regions, by, min(share for _, share in kinds.values()), keep=keep), F.col("right")
    smallest = [F.min(F.when(fit(b) & (F.col("ratio") >= share), b["id"])).alias(name) for name, (fit, share) in kinds.items()]
    found = pairs.groupBy(*by, "left").agg(*smallest)
    found = found.select(*(F.col(c).alias(f"_{c}") for c in by), *(F.col(f"left.{c}").alias(f"_{c}") for c in ("id", *EDGES)), *kinds)
    same = F.lit(True)
    for c in (*by, "id", *EDGES):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return boxes.join(found, same, "left").select(*boxes.columns, *kinds)


def first_matches(boxes: DataFrame, regions: DataFrame, by: list[str], threshold: float, name: str) -> DataFrame:
    """The boxes, each row once, with the smallest id of a region that covers enough of it as ``name``, or null."""
    return matches(boxes, regions, by, {name: (lambda _: F.lit(True), threshold)})


def confirmed(regions: DataFrame, candidates: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """The regions, each row once, with ``confirmed``: a candidate of the page shares enough of the smaller of the two, or the page
    has no candidates at all."""
    met = overlapping(regions, candidates, by, threshold, of="smaller").select(*(F.col(c).alias(f"_{c}") for c in by), *(F.col(f"left.{c}").alias(f"_{c}") for c in ("id", *EDGES))).distinct()
    pages = candidates.select(*(F.col(c).alias(f"_{c}") for c in by)).distinct().withColumn("_any", F.lit(True))
    same_page = same = F.lit(True)
    for c in (*by, "id", *EDGES):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        same_page = same_page & (F.col(c).eqNullSafe(F.col(f"_{c}")) if c in by else F.lit(True))
    rows = regions.join(met.withColumn("_hit", F.lit(True)), same, "left").select(*regions.columns, "_hit").join(pages, same_page, "left")
    return rows.select(*regions.columns, F.coalesce("_hit", F.col("_any").isNull()).alias("confirmed"))
