"""Connected components of fragments, and the blocks of text that they are."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T


def kept(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder, so that a lost executor costs a read and not the rounds before."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints"
    path = f"{folder}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    KEPT[id(out)] = out, path
    return out


#: Tables of ``kept`` and their folders.
KEPT: dict[int, tuple[DataFrame, str]] = {}


def dropped(df: DataFrame) -> None:
    """Removes a table of ``kept``; it can't be read any more."""
    path = KEPT.pop(id(df), (None, None))[1]
    if path:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def _stars(edges: DataFrame) -> DataFrame:
    """One round: neighbours larger than a node go to the smallest around it, then a node and its smaller ones to their smallest."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # joined where the rows are: no table of edges passes through the driver, however small a round leaves it
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")).hint("merge")
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m")).hint("merge")
    # each row has its larger end first
    near = large.join(least, "a")
    small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b")))
    return small.where("a <> b").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each of ``nodes`` (node) reaches by ``edges`` (a, b); itself, if none.

    Rounds of large and small stars: a chain of n nodes takes about log n of them, and no task holds a component. Repeated
    nodes count once; edges with a null end, loops and repeated edges add nothing; ends that are no nodes connect all the same.
    """
    rows = kept(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    before = mark(rows)
    while before[0]:
        old, rows = rows, kept(_stars(rows))
        dropped(old)
        now = mark(rows)
        if now == before:
            break
        before = now
    roots = rows.select(F.col("a").alias("_a"), "b").hint("merge")
    return nodes.select("node").distinct().join(roots, F.col("node") == F.col("_a"), "left").select("node", F.coalesce("b", "node").alias("component"))


def reconstructed(fragments: DataFrame, boundaries: DataFrame) -> DataFrame:
    """first, fragments, operations and text of each block of fragments (node, rank, text) that boundaries (a, b, operation, join,
    veto) make one.

    A boundary joins where ``join`` holds and no row of its two fragments has a ``veto``. Members stand in order of rank; between
    two of them stands what their own boundary says (a hyphen taken out or kept, else a space), and a space where they have none.
    Repeated nodes are one fragment, the text the first by order; null texts are empty.
    """
    held = fragments.groupBy("node").agg(F.min(F.struct("rank", F.coalesce("text", F.lit("")).alias("text"))).alias("f")).select("node", "f.rank", "f.text")
    pair = boundaries.where("a is not null and b is not null").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.bool_or(F.coalesce("join", F.lit(False))).alias("join"), F.bool_or(F.coalesce("veto", F.lit(False))).alias("veto"), F.min("operation").alias("operation")
    ).where("join and not veto")
    pair = kept(pair.select("a", "b", "operation"))
    found = components(held.select("node"), pair)
    rows = held.join(found.hint("merge"), "node")
    # the operation stands with the later fragment, under the earlier one's name
    seen = rows.select("node", "rank", "component")
    ends = pair.join(seen.select(F.col("node").alias("a"), F.col("rank").alias("ra")).hint("merge"), "a").join(seen.select(F.col("node").alias("b"), F.col("rank").alias("rb")).hint("merge"), "b")
    later = F.struct("ra", "a") > F.struct(F.col("rb").alias("ra"), F.col("b").alias("a"))
    links = ends.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("node"), F.struct(F.when(later, F.col("b")).otherwise(F.col("a")).alias("with"), "operation").alias("l"))
    links = links.groupBy("node").agg(F.collect_list("l").alias("links")).hint("merge")
    member = F.struct("rank", "node", "text", "links")
    blocks = rows.join(links, "node", "left").groupBy("component").agg(F.array_sort(F.collect_list(member)).alias("m"))
    operation = lambda x, before: F.coalesce(F.filter(x["links"], lambda l: l["with"] == before)[0]["operation"], F.lit("insert_space"))

    def step(a: Column, x: Column) -> Column:
        how = operation(x, a["node"])
        # a hyphen that is not there can't be taken out
        how = F.when((how == "remove_layout_hyphen") & ~T.rstrip(a["text"]).endswith("-"), "insert_space").otherwise(how)
        return F.struct(x["node"].alias("node"), F.coalesce(T.apply_join(a["text"], x["text"], how), a["text"]).alias("text"), F.array_append(a["operations"], how).alias("operations"))

    first = F.col("m")[0]
    start = F.struct(first["node"].alias("node"), first["text"].alias("text"), F.array().cast("array<string>").alias("operations"))
    folded = blocks.select(first["node"].alias("first"), F.size("m").alias("fragments"), F.aggregate(F.slice("m", 2, F.size("m")), start, step).alias("t"))
    return folded.select("first", "fragments", F.array_join("t.operations", ",").alias("operations"), F.col("t.text").alias("text"))
