"""A Merkle manifest of a dataset: a hash tree per source and one over the sources, with a proof for every row.

Leaves are hashed where texts are read; from there on a row is its id and its digests. Rows get their place in their source
from a range exchange: a partition's rows are numbered where they are sorted, and the totals of the partitions before are
added. Places are cut into buckets of ``ARITY ** LEVELS``, aligned with the tree, so a bucket is a whole subtree and a source
of any size is many buckets. An executor takes buckets as Arrow tables and lets DuckDB run a query a level: an ordered
``string_agg`` of each run of siblings, hashed by ``sha256``. The bucket roots, 1 in 4,096 rows, go through the same step until
each source has one node, and the sources' nodes until there is one root.

The proofs come back down the same way: each step hands every bucket the siblings outside it, which travel once a bucket, as
a row among its rows, and the last step, over the leaves, hashes the proof and folds the row's own digest up to the root.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.text import lean, trimmed, written

#: Siblings of a run, and levels that a bucket spans.
ARITY, LEVELS = 16, 3
BUCKET = ARITY**LEVELS
#: Rows from which whole buckets go to DuckDB; a bucket has BUCKET rows at most.
TOGETHER = BUCKET
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column, text: bool) -> Column:
    """A field of a leaf: its length in UTF-8 bytes, a colon and its value, or a dash for null."""
    value = value if text else value.cast("long").cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column) -> Column:
    parts = [field(F.col("doc_id"), False), field(F.col("source"), True), field(F.col("lang"), True), field(F.col("n_chars"), False), field(text, True)]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def numbered(nodes: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The nodes with ``place``, from 0 within their group, and ``size``, the group's number of nodes."""
    spread = nodes.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    ready = written(spread.withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", 33).alias("part")
    runs = ready.groupBy(*group, part).agg(F.min("row").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(*group)
    # a group has a row here for each partition that it reaches
    runs = runs.withColumn("size", F.sum("n").over(whole)).withColumn("before", F.sum("n").over(whole.orderBy("part")) - F.col("n"))
    runs = runs.select(*(F.col(c).alias(f"of_{c}") for c in group), F.col("part").alias("of_part"), "first", "size", "before")
    same = part == F.col("of_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return ready.join(runs, same).withColumn("place", F.col("before") + F.col("row") - F.col("first")).select(*nodes.columns, "place", "size")


def levels(size: int) -> int:
    """Levels from a tree's nodes up to their bucket's root."""
    out = 0
    while size > 1 and out < LEVELS:
        size, out = -(-size // ARITY), out + 1
    return out


SIDE = "array<struct<before:string,after:string>>"
#: A node's run of siblings at each level of its bucket, cut at the node's own digest on that level.
PATHS = " UNION ALL ".join(
    f"""SELECT n.bucket, n.place, {up} AS up, (n.place // {ARITY**up}) % {ARITY} AS nth, r.run FROM level0 n
    JOIN (SELECT bucket, place // {ARITY} AS place, string_agg(h, '' ORDER BY place) AS run FROM level{up} WHERE tall > {up} GROUP BY ALL) r
    ON n.bucket = r.bucket AND n.place // {ARITY ** (up + 1)} = r.place"""
    for up in range(LEVELS)
)
SIDES = f"SELECT bucket, place, list({{'before': substr(run, 1, 64 * nth), 'after': substr(run, 64 * nth + 65)}} ORDER BY up) AS sides FROM ({PATHS}) GROUP BY ALL"


def connection() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "temp_directory": ""})


def gathered(batches: Iterator[pa.RecordBatch], together: int = TOGETHER) -> Iterator[pa.Table]:
    """Tables of whole buckets, numbered in a column ``bucket``; the rows come sorted by tree and number."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def numbered_table() -> pa.Table:
        whole = pa.Table.from_batches(held).combine_chunks()
        tree = whole.column("tree").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        number = whole.column("number").to_numpy()
        fresh = np.r_[False, (tree[1:] != tree[:-1]) | (number[1:] != number[:-1])]
        return whole.append_column("bucket", pa.array(np.cumsum(fresh)))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < together:
            continue
        table = numbered_table()
        keys = table.column("bucket").to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield table.slice(0, last)
            held = table.slice(last).drop_columns(["bucket"]).to_batches()
            rows = sum(b.num_rows for b in held)
    if rows:
        yield numbered_table()


def climbed(con: duckdb.DuckDBPyConnection, table: pa.Table) -> None:
    """DuckDB's tables of the buckets' nodes, level by level: (bucket, tall, place, h). The table's rows are the lowest."""
    tall = {int(s): levels(int(s)) for s in np.unique(table.column("size").to_numpy())}
    nodes = pa.table({"bucket": table.column("bucket"), "tall": pa.array([tall[s] for s in table.column("size").to_pylist()], pa.int32()), "place": table.column("place").to_numpy() % BUCKET, "h": table.column("h")})
    con.register("nodes", nodes)
    con.execute("CREATE OR REPLACE TEMP TABLE level0 AS SELECT * FROM nodes")
    con.unregister("nodes")
    for up in range(1, LEVELS + 1):
        con.execute(f"""
            CREATE OR REPLACE TEMP TABLE level{up} AS
            SELECT bucket, any_value(tall) AS tall, place // {ARITY} AS place, sha256(string_agg(h, '' ORDER BY place)) AS h
            FROM level{up - 1} WHERE tall >= {up} GROUP BY bucket, place // {ARITY}""")


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The root of each bucket, with its place in its tree's next row of buckets."""
    con = connection()
    for table in gathered(batches):
        climbed(con, table)
        con.register("rows", table)
        out = con.sql(f"""
            SELECT b.tree, b.number AS place, ((b.size + {BUCKET - 1}) // {BUCKET})::BIGINT AS size, r.h
            FROM (SELECT bucket, any_value(tree) AS tree, any_value(number) AS number, any_value(size) AS size FROM rows GROUP BY bucket) b
            JOIN ({" UNION ALL ".join(f"SELECT bucket, h FROM level{up} WHERE tall = {up}" for up in range(LEVELS + 1))}) r USING (bucket)""").to_arrow_table()
        con.unregister("rows")
        yield from out.to_batches()
    con.close()


def _paths(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Nodes with what stands beside their path at every level up to the root; of the ``last`` ones what becomes of it."""
    con = connection()
    for table in gathered(batches):
        kind = pa.array(table.column("kind").to_numpy() == 1)
        rows = table.filter(kind)
        climbed(con, rows)
        for name, part in (("rows", rows), ("above", table.filter(pa.array(table.column("kind").to_numpy() == 0)))):
            con.register(name, part)
        # an own path may have no level: a lone node is its bucket's root
        con.execute(f"""
            CREATE OR REPLACE TEMP TABLE path AS
            SELECT r.* EXCLUDE (sides, subroot, root, kind, bucket, number), list_concat(coalesce(s.sides, []), a.sides) AS sides, a.subroot, a.root
            FROM rows r JOIN above a USING (bucket) LEFT JOIN ({SIDES}) s ON s.bucket = r.bucket AND s.place = r.place % {BUCKET}""")
        con.unregister("rows")
        con.unregister("above")
        if not last:
            yield from con.sql("SELECT tree, place, sides, subroot, root FROM path").to_arrow_table().to_batches()
            continue
        depth = con.execute("SELECT coalesce(max(len(sides)), 0) FROM path").fetchall()[0][0]
        folded = "SELECT *, coalesce(tampered, h) AS f FROM path"
        for up in range(1, depth + 1):
            folded = f"SELECT * REPLACE (CASE WHEN len(sides) >= {up} THEN sha256(sides[{up}].before || f || sides[{up}].after) ELSE f END AS f) FROM ({folded})"
        yield from con.sql(f"""
            SELECT doc_id, h AS leaf, subroot, root, sha256(array_to_string(list_transform(sides, lambda s: s.before || s.after), '')) AS proof_sha256, f AS folded_root, f = root AS verified
            FROM ({folded})""").to_arrow_table().to_batches()
    con.close()


def bucketed(nodes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """Nodes by bucket, in order of their places; ``above``, a row a bucket, comes before its bucket's nodes."""
    rows = nodes.withColumn("number", F.floor(F.col("place") / BUCKET))
    if above is not None:
        up = above.select("tree", F.col("place").alias("number"), "sides", "subroot", "root")
        rows = rows.withColumn("kind", F.lit(1)).unionByName(up.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    order = ["tree", "number", *(["kind"] if above is not None else []), "place"]
    return lean(rows).repartition("tree", "number").sortWithinPartitions(*order)


def grown(nodes: DataFrame) -> list[DataFrame]:
    """The nodes and, above them, the roots of their buckets, theirs, and so on until every tree has one node."""
    out = [nodes]
    while len(out) == 1 or (out[-1].agg(F.max("size")).first()[0] or 1) > 1:
        rows = bucketed(out[-1].select("tree", "place", "size", "h"))
        out.append(written(rows.mapInArrow(lambda it: trimmed(_roots(it)), "tree string, place long, size long, h string")))
    return out


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row.

    A leaf hashes the row's doc_id, source, lang, n_chars and text. A source's leaves ascend by doc_id, nulls first; rows of one id by their leaf, so repeated rows stand side by
    side, each with a proof of its own. Runs of ``ARITY`` siblings become their hash until one node, the subroot, remains; the
    subroots, by source with null first, become the root likewise. The proof hashes the siblings level by level. Rows whose
    id's CRC-32 is divisible by 5 are tampered with: their text's A-Z become lower case, and folded_root starts from the leaf
    of that text; rows with a null id or text stay as they are. No rows, no result. Columns used: doc_id, source, lang,
    n_chars, text.
    """
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", UPPER, LOWER)
    slim = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("tree"), leaf(F.col("text")).alias("h"), F.when(touched & F.col("text").rlike("[A-Z]"), leaf(lowered)).alias("tampered"))
    leaves = written(slim)
    placed = written(numbered(leaves, ["tree"], ["doc_id", "h", "tampered"]))
    sources = grown(placed)
    subroots = sources[-1].select(F.col("tree").alias("source"), "h")
    ranked = written(numbered(subroots, [], ["source"]).withColumn("tree", F.lit("")))
    trees = grown(ranked)

    top = trees[-1].select("tree", "place", F.lit(None).cast("string").alias("subroot"), F.col("h").alias("root"), F.array().cast(SIDE).alias("sides"))
    schema = f"tree string, place long, sides {SIDE}, subroot string, root string"
    for nodes in reversed(trees[:-1]):
        top = written(bucketed(nodes.select("tree", "place", "size", "h"), top).mapInArrow(lambda it: trimmed(_paths(it, False)), schema))
    # from the tree over the sources to the trees of the sources: a subroot is the one node that its source's tree ends in
    top = ranked.drop("tree").join(top, "place").select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("place"), "sides", F.col("h").alias("subroot"), "root")
    for nodes in reversed(sources[1:-1]):
        top = written(bucketed(nodes, top).mapInArrow(lambda it: trimmed(_paths(it, False)), schema))
    out = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return bucketed(placed, top).mapInArrow(lambda it: trimmed(_paths(it, True)), out)


def query(spark, sf_dir: str) -> DataFrame:
    from quire.llm.text import table

    return manifest(table(spark, sf_dir, "documents"))


def _sql(levels: int = 6) -> str:
    """Both trees level by level, for up to 16**levels leaves a source and sources."""
    text = f"translate(text, '{UPPER}', '{LOWER}')"
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"
    some = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    h = lambda t: "sha256(" + " || ".join(some(x) for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", t)) + ")"
    parts = [
        f"l AS MATERIALIZED (SELECT doc_id, source, {h('text')} AS leaf, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {h(text)} ELSE {h('text')} END AS f FROM documents)",
        "s0 AS MATERIALIZED (SELECT doc_id, source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS n, leaf AS h, leaf, f FROM l)",
    ]

    def climb(t: str) -> None:
        for i in range(levels):
            parts.append(f"{t}{i + 1} AS MATERIALIZED (SELECT g, p // 16 AS p, (any_value(n) + 15) // 16 AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h FROM {t}{i} GROUP BY g, p // 16)")

    climb("s")
    parts.append(f"t0 AS MATERIALIZED (SELECT NULL::VARCHAR AS g, g AS source, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p, count(*) OVER () AS n, h FROM s{levels})")
    climb("t")
    now = "SELECT d.doc_id, d.leaf, d.f, '' AS proof, d.g, d.p, t0.p AS q, t0.h AS subroot, root.h AS root FROM s0 d JOIN t0 ON d.g IS NOT DISTINCT FROM t0.source, t{0} root".format(levels)
    for t, p in (("s", "p"), ("t", "q")):
        for i in range(levels):
            run = f"(SELECT g, p // 16 AS k, any_value(n) AS n, string_agg(h, '' ORDER BY p) AS run FROM {t}{i} GROUP BY g, p // 16)"
            on = f"r.k = d.{p} // 16" + (" AND r.g IS NOT DISTINCT FROM d.g" if t == "s" else "")
            at = f"64 * (d.{p} % 16)"
            now = f"SELECT d.* REPLACE (d.{p} // 16 AS {p}, CASE WHEN n = 1 THEN f ELSE sha256(substr(run, 1, {at}) || f || substr(run, {at} + 65)) END AS f, CASE WHEN n = 1 THEN proof ELSE proof || substr(run, 1, {at}) || substr(run, {at} + 65) END AS proof) FROM ({now}) d JOIN {run} r ON {on}"
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM ({now})"


SQL = _sql()
