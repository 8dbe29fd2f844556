"""A log of imports and undos over a table of items: what is in force, its state at any time, and what an import changes.

The log is only appended to. An undo takes back the latest import of its scope that is still in force, so imports and undos are
brackets: a running depth tells at which level each stands, and on one level imports and the undos that take them back alternate.
No state is carried from row to row but sums and smallest values of windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_force(log: DataFrame) -> DataFrame:
    """The log (scope, at, action, sha) with ``status``, one row an entry.

    ``action`` is import or undo, ``at`` the entry's place in its scope. An import of a SHA that the scope has imported before is
    "already_applied" and changes nothing; others are "applied" or, where an undo takes them back, "undone". An undo is
    "undo" or, with nothing in force, "nothing_to_undo". Entries alike in scope and place are ordered by action and SHA.
    """
    order = ["at", "action", "sha"]
    again = (F.col("action") == "import") & (F.row_number().over(Window.partitionBy("scope", "action", "sha").orderBy(*order)) > 1)
    rows = log.select("scope", "at", "action", "sha").withColumn("again", again)
    upto = Window.partitionBy("scope").orderBy(*order, "again").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("again"), 0).when(F.col("action") == "import", 1).otherwise(-1)
    rows = rows.withColumn("step", step).withColumn("sum", F.sum("step").over(upto))
    # undos of nothing would lead below the ground, which they lower
    rows = rows.withColumn("floor", F.least(F.lit(0), F.min("sum").over(upto)))
    before = F.lag("floor", 1, 0).over(Window.partitionBy("scope").orderBy(*order, "again"))
    rows = rows.withColumn("idle", (F.col("step") == -1) & (F.col("floor") < before))
    # an import stands on the level that it leads to, an undo on the one that it leaves
    rows = rows.withColumn("level", F.when(~F.col("again") & ~F.col("idle"), F.col("sum") - F.col("floor") + F.when(F.col("step") == -1, 1).otherwise(0)))
    then = F.lead("action").over(Window.partitionBy("scope", "level").orderBy(*order))
    status = (
        F.when(F.col("again"), "already_applied").when(F.col("idle"), "nothing_to_undo").when(F.col("action") == "undo", "undo").when(then == "undo", "undone").otherwise("applied")
    )
    return rows.select("scope", "at", "action", "sha", status.alias("status"))


def state(base: DataFrame, log: DataFrame, patches: DataFrame, at: int | None = None) -> DataFrame:
    """scope, item, field, value: the base (scope, item, field, value) with what is in force after the log's entries up to
    ``at`` (None: all).

    ``patches`` (scope, at, item, field, place, value) are what imports set, later places of one import over earlier ones. Only
    fields of the base are set: unknown items and fields are left out. A field that is set to null is null.
    """
    if at is not None:
        log = log.where(F.col("at") <= at)
    kept = in_force(log).where("status = 'applied'").select("scope", "at").distinct()
    last = kept.join(patches, ["scope", "at"]).groupBy("scope", "item", "field").agg(F.max(F.struct("at", "place", "value")).alias("last"))
    key = ["scope", "item", "field"]
    return base.join(last, key, "left").select(*key, F.when(F.col("last").isNull(), F.col("value")).otherwise(F.col("last.value")).alias("value"))


def preview(current: DataFrame, patch: DataFrame) -> DataFrame:
    """scope, item, field, old_value, new_value, kind for what a patch (scope, item, field, place, value) would do to a state:
    "changed" or "unknown_item"; what it sets to the value that is there is no change."""
    key = ["scope", "item", "field"]
    new = patch.groupBy(*key).agg(F.max(F.struct("place", "value"))["value"].alias("new_value"))
    both = new.join(current.select(*key, F.col("value").alias("old_value"), F.lit(True).alias("known")), key, "left")
    kind = F.when(F.col("known").isNull(), "unknown_item").otherwise("changed")
    return both.where(F.col("known").isNull() | ~F.col("old_value").eqNullSafe(F.col("new_value"))).select(*key, "old_value", "new_value", kind.alias("kind"))
