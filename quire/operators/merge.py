"""Precedence, interval and overlap joins; review patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precedence(base: DataFrame, middle: DataFrame, manual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field by field the manual value, else the middle one, else the base's; a manual row hides the middle row whole."""
    m = middle.select(key, F.lit(True).alias("_m"), *(F.col(f).alias(f"_m_{f}") for f in fields))
    h = manual.select(key, F.lit(True).alias("_h"), *(F.col(f).alias(f"_h_{f}") for f in fields))
    rows = base.join(m, key, "left").join(h, key, "left")
    pick = lambda f: F.when(F.col("_h"), F.coalesce(f"_h_{f}", f)).otherwise(F.coalesce(f"_m_{f}", f)).alias(f)
    source = F.when(F.col("_h"), "manual").when(F.col("_m"), "middle").otherwise("base").alias("evidence")
    return rows.select(key, *map(pick, fields), source)


def in_interval(points: DataFrame, intervals: DataFrame, by: str, point: str, first: str, last: str, bucket: int = 64) -> DataFrame:
    """Points with the intervals that hold them, ends included, as an equi-join on buckets of the axis.

    A range spans few buckets, so no pair is formed that does not share one; each pair meets in the point's bucket alone.
    """
    spread = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col(first) / bucket), F.floor(F.col(last) / bucket))))
    return points.withColumn("_b", F.floor(F.col(point) / bucket)).join(spread, [by, "_b"]).where(F.col(point).between(F.col(first), F.col(last))).drop("_b")


def quarantine(units: DataFrame, membership: DataFrame) -> DataFrame:
    """Units (unit, source, pages) by the sections of their pages: mapped, none found, or across a boundary."""
    pages = units.select("unit", "source", F.explode("pages").alias("page"))
    found = pages.join(membership.select("source", "page", "section"), ["source", "page"], "left").groupBy("unit").agg(F.array_sort(F.collect_set("section")).alias("sections"))
    n = F.size("sections")
    status = F.when(n == 0, "no_section_found").when(n > 1, "crosses_section_boundary").otherwise("mapped")
    return found.select("unit", status.alias("status"), F.when(n == 1, F.element_at("sections", 1)).alias("section"))


def overlap_ratio(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Shared area of two boxes over the first one's."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return w * h / F.greatest(F.lit(1e-9), (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]))


def unique_match(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of the left with the right's value if all that match agree on one; ambiguous and absent ones are named so."""
    found = right.groupBy(key).agg(F.count_distinct(value).alias("n"), F.min(value).alias("value"))
    joined = left.join(found, key, "left")
    return joined.withColumn("status", F.when(F.col("n").isNull(), "absent").when(F.col("n") > 1, "ambiguous").otherwise("matched")).withColumn("value", F.when(F.col("n") == 1, F.col("value"))).drop("n")


def last_before(rows: DataFrame, by: str, order: str, value: Column) -> Column:
    """The latest non-null value before each row."""
    return F.last(value, True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))


def differing(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per key and field whose values differ, nulls being values, and per key on one side only."""
    both = old.select(key, F.lit(1).alias("_o"), *(F.col(f).cast("string").alias(f"_o_{f}") for f in fields)).join(
        new.select(key, F.lit(1).alias("_n"), *(F.col(f).cast("string").alias(f"_n_{f}") for f in fields)), key, "full"
    )
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_o_{f}").alias("old_value"), F.col(f"_n_{f}").alias("new_value")) for f in fields))
    kind = F.when(F.col("_o").isNull(), "unknown_item").when(F.col("_n").isNull(), "missing_item").otherwise("changed")
    rows = both.select(key, kind.alias("kind"), F.explode(cells).alias("c")).select(key, "kind", "c.*")
    return rows.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def reconciled(cache: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """A valid cache row beats the state; a validated state without one becomes failed_retryable."""
    both = cache.select(key, F.col("valid")).join(state.select(key, "status"), key, "full")
    status = F.when(F.col("valid"), "validated").when(F.col("status") == "validated", "failed_retryable").otherwise(F.coalesce("status", F.lit("unknown_unit")))
    return both.select(key, status.alias("status"), (F.coalesce("status", F.lit("")) != status).alias("changed"))


def linked_notes(references: DataFrame, notes: DataFrame) -> DataFrame:
    """References (reference, book, page, label) with note_id and status: the note of their label on their page if it is a
    footnote, else those of chapters from there on, else those of the document; linked only if these are one note.

    References meet no notes one by one. Per (book, label, page) the smallest and largest id of each scope tell whether it is
    one note; chapter notes from a page on are a running pair from the last page back, over at most a row a page. A reference
    whose book, page or label is null is unresolved; every reference row has one row.
    """
    spot = ["book", "label", "page"]
    scopes = {"footnote": "foot", "chapter_endnote": "chapter", "document_endnote": "document"}
    ends = [f(F.when(F.col("scope") == scope, F.col("note_id"))).alias(f"{name}_{end}") for scope, name in scopes.items() for end, f in (("low", F.min), ("high", F.max))]
    held = notes.groupBy(*spot).agg(*ends)
    asked = references.select(*spot).where(" and ".join(f"{c} is not null" for c in spot)).distinct()
    rows = held.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    rows = rows.groupBy(*spot).agg(F.bool_or("_asked").alias("_asked"), *(F.min(f"{n}_{e}").alias(f"{n}_{e}") for n in scopes.values() for e in ("low", "high")))
    onward = Window.partitionBy("book", "label").orderBy(F.desc("page")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("book", "label")
    over = {"foot": lambda c, f: F.col(c), "chapter": lambda c, f: f(c).over(onward), "document": lambda c, f: f(c).over(whole)}
    tiers = [(over[n](f"{n}_low", F.min), over[n](f"{n}_high", F.max)) for n in scopes.values()]
    low, high = (F.coalesce(*(t[end] for t in tiers)).alias(name) for end, name in ((0, "low"), (1, "high")))
    found = rows.select(*spot, "_asked", low, high).where("_asked and low is not null").drop("_asked")
    status = F.when(F.col("low").isNull(), "unresolved").when(F.col("low") == F.col("high"), "linked").otherwise("ambiguous")
    return references.join(found, spot, "left").select("reference", status.alias("status"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("note_id"))


#: Words of a key, and characters of one for items without a word inside.
KEY_WORDS, KEY_CHARS = 4, 6


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of texts that hold an item's text as it stands; null and empty items are held by none.

    Words inside an item, its first and last left out, are whole words wherever it stands. The first ``KEY_WORDS`` of them (all, if
    fewer: the item's class) are its key, and a text sends a row for each run of words of a class that occurs, with the words beside the
    run, so what meets and fits at both sides is nearly always a hit. Items of one or two words are a class by their first
    characters. Only ids go on; each text is looked at once more for what it met. Rows of one id count as one text each;
    a pair is reported once.
    """
    words = lambda c: F.filter(F.split(c, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    known = items.where("text is not null and text <> ''").select("item_id", F.col("text").alias("item"), words(F.col("text")).alias("w"))
    n = F.size("w")
    kind = F.when(n >= 3, F.least(n - 2, F.lit(KEY_WORDS))).otherwise(-F.least(F.length("item"), F.lit(KEY_CHARS)))
    known = known.withColumn("kind", kind).withColumn("key", F.when(F.col("kind") > 0, F.xxhash64(F.array_join(F.slice("w", F.lit(2), F.greatest("kind", F.lit(1))), " "))).otherwise(F.xxhash64(F.left("item", -F.col("kind")))))
    # what stands beside the key in the item: the word before it ends, the word behind it begins that of the text
    known = known.select("item_id", "item", "kind", "key", F.when(F.col("kind") > 0, F.get("w", F.lit(0))).otherwise("").alias("left"), F.when(F.col("kind") > 0, F.get("w", F.col("kind") + 1)).otherwise("").alias("right"))
    classes = sorted(r.kind for r in known.select("kind").distinct().collect())
    rows = docs.select("doc_id", F.xxhash64("text").alias("print"), "text").where("text is not null")

    def runs(k: int) -> Column:
        if k < 0:
            grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") + k + 1), lambda i: F.xxhash64(F.substring("text", i, F.lit(-k)))))
            each = F.transform(grams, lambda h: F.struct(F.lit(k).alias("kind"), h.alias("key"), F.lit("").alias("before"), F.lit("").alias("after")))
            return F.when(F.length("text") >= -k, each)
        at = F.sequence(F.lit(1), F.size("w") - k - 1)
        each = F.transform(at, lambda i: F.struct(F.lit(k).alias("kind"), F.xxhash64(F.array_join(F.slice("w", i + 1, k), " ")).alias("key"), F.get("w", i - 1).alias("before"), F.get("w", i + k).alias("after")))
        return F.when(F.size("w") >= k + 2, each)

    empty = F.array().cast("array<struct<kind:int,key:bigint,before:string,after:string>>")
    sent = rows.withColumn("w", words(F.col("text"))).select("doc_id", "print", F.explode(F.concat(empty, *(F.coalesce(runs(k), empty) for k in classes))).alias("r")).select("doc_id", "print", "r.*")
    met = sent.join(known.drop("item"), ["kind", "key"]).where(F.endswith("before", "left") & F.startswith("after", "right")).select("doc_id", "print", "item_id").distinct()
    met = met.join(known.select("item_id", "item"), "item_id").select(F.col("doc_id").alias("_doc"), F.col("print").alias("_print"), "item_id", "item")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("print") == F.col("_print"))
    return rows.join(met, same).where(F.contains("text", "item")).select("doc_id", "item_id").distinct()
