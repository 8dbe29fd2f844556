"""Pages, lines, edges, blocks and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


#: Rows that are numbered together: a task sorts no more of a book than a range of about so many.
RANGE = 1 << 20


def numbered_pages(docs: DataFrame, book: str = "source", order: str = "doc_id", ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds page, the row's place in its book from 1; rows of one id are in order of ``ties``, null ids come first.

    A table of several RANGEs of rows is cut into as many ranges of ids, equally wide; they are numbered apart and moved up
    by the rows of the ranges before, so a large book is no large task. The column's metadata says how many ranges there are:
    one needs no second pass. Columns made of long texts should be reduced to what is needed before: they travel with
    the row.
    """
    low, high, n = docs.agg(F.min(order), F.max(order), F.count("*")).first()
    ranges = max(1, -(-n // RANGE))
    page = lambda c: c.cast("int").alias("page", metadata={"ranges": ranges})
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if ranges == 1 or low is None:
        return docs.select(*columns, page(F.row_number().over(Window.partitionBy(book).orderBy(order, *ties))))
    width = max(1, (high - low) // ranges + 1)
    rows = docs.withColumn("_range", F.coalesce(F.floor((F.col(order).cast("double") - low) / width), F.lit(-1)))
    upto = Window.partitionBy(book).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(book, "_range").agg(F.count("*").alias("_n")).select(F.col(book).alias("_book"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(book, "_range").orderBy(order, *ties)))
    joined = placed.join(sizes, F.col(book).eqNullSafe(F.col("_book")) & (F.col("_range") == F.col("_r")))
    return joined.select(*columns, page(F.col("_place") + F.col("_before")))


def one_range(pages: DataFrame) -> bool:
    """Whether numbered pages are known to fit a task, book by book."""
    return pages.schema["page"].metadata.get("ranges") == 1


def page_range(pages: DataFrame) -> Column:
    """The range of pages that a page is worked on with: one for all where they fit."""
    return F.lit(0).cast("long") if one_range(pages) else F.floor((F.col("page") - 1) / RANGE)


def beside(pages: DataFrame, *columns: str, step: int = 1, name: str = "next") -> DataFrame:
    """Adds a struct of columns of the page so many (1 or -1) pages on in the same book, null where there is none.

    Pages are numbered without gaps: the page beside is the row beside within a range of pages, and of a range's last (or
    first) page the one row that the next (or last) range begins (or ends) with.
    """
    if step not in (1, -1):
        raise ValueError("step must be 1 or -1")
    there = F.struct(*columns)
    rows = pages.withColumn("_range", page_range(pages))
    w = Window.partitionBy("source", "_range").orderBy("page")
    within = (F.lead if step == 1 else F.lag)(there).over(w)
    if one_range(pages):
        return pages.withColumn(name, (F.lead if step == 1 else F.lag)(there).over(Window.partitionBy("source").orderBy("page")))
    edge = rows.where((F.col("page") - int(step == 1)) % RANGE == 0).select(F.col("source").alias("_source"), (F.col("_range") - step).alias("_beside"), there.alias("_there"))
    joined = rows.withColumn(name, within).join(edge, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_beside")), "left")
    # within a range only its outermost page has none beside it
    outer = (F.col("page") - int(step == -1)) % RANGE == 0
    return joined.select(*(F.col(f"`{c}`") for c in pages.columns), F.when(outer, F.col("_there")).otherwise(F.col(name)).alias(name))


def running(pages: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the largest value up to each page of its book: within its range of pages, and of the ranges before."""
    rows = pages.withColumn("_range", page_range(pages)).withColumn("_own", value)
    within = F.max("_own").over(Window.partitionBy("source", "_range").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    columns = [F.col(f"`{c}`") for c in pages.columns]
    if one_range(pages):
        w = Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
        return pages.withColumn(name, F.max(value).over(w))
    before = Window.partitionBy("_source").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(F.col("source").alias("_source"), F.col("_range").alias("_r")).agg(F.max("_own").alias("_m")).select("_source", "_r", F.max("_m").over(before).alias("_carry"))
    joined = rows.withColumn("_within", within).join(carried, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r")))
    return joined.select(*columns, F.greatest("_within", "_carry").alias(name))


def counted(pages: DataFrame, holds: Column, name: str) -> DataFrame:
    """Adds the number of pages up to each of its book where ``holds``: within its range of pages, and of the ranges before."""
    rows = pages.withColumn("_range", page_range(pages)).withColumn("_one", F.when(holds, 1).otherwise(0))
    within = F.sum("_one").over(Window.partitionBy("source", "_range").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    columns = [F.col(f"`{c}`") for c in pages.columns]
    if one_range(pages):
        return rows.withColumn(name, within).select(*columns, name)
    before = Window.partitionBy("_source").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(F.col("source").alias("_source"), F.col("_range").alias("_r")).agg(F.sum("_one").alias("_m")).select("_source", "_r", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_carry"))
    joined = rows.withColumn("_within", within).join(carried, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r")))
    return joined.select(*columns, (F.col("_within") + F.col("_carry")).alias(name))


def sections(pages: DataFrame) -> DataFrame:
    """Numbered pages (source, page, kind) with the number of their section: start kinds open one, body goes on with a chapter or
    with body, blanks extend.

    Whether a page opens a section is told by its kind and that of the last page before it that is not blank, so no list of a
    book's pages is made.
    """
    kind, rows = F.col("kind"), running(pages, F.when(F.col("kind") != "blank", F.struct("page", "kind")), "_last")
    rows = beside(rows, "_last", step=-1, name="_before")
    # null where all pages before are blank
    last = F.col("_before._last.kind")
    goes_on = F.coalesce(F.when(kind == "body", last.isin("body", "chapter")).when(kind == "chapter", False).otherwise(kind == last), F.lit(False))
    opens = (F.col("page") == 1) | ((kind != "blank") & ~goes_on)
    return counted(rows, opens, "section").drop("_last", "_before").withColumn("section", F.col("section").cast("int"))


def intake_summary(scored: DataFrame) -> DataFrame:
    """Per book: pages, passed, and by route; the pages to review, sorted."""
    return scored.groupBy("source").agg(
        F.count("*").alias("pages"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("review"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("page")))).cast("array<string>"), ",").alias("review_pages"),
        F.min("text_characters").alias("min_chars"), F.max("text_characters").alias("max_chars"), F.sum("text_characters").alias("chars"), F.bround(F.avg("text_characters"), 2).alias("mean_chars"),
    )


def edge_lines(text: Column, depth: int = 3) -> Column:
    """The first and last ``depth`` non-blank lines of a page."""
    return T.let(T.lines(text), lambda rows: F.concat(F.slice(rows, 1, depth), F.slice(rows, F.greatest(F.size(rows) - depth + 1, F.lit(1)), F.lit(depth))))


#: The longest running line; a key grows to twice its line by lower case and ß at most, so a line of more letters than that has no running line's key.
SHORT = 60
LONG = f"^(?:[^A-Za-z]*+[A-Za-z]){{{2 * SHORT + 1}}}"


def running_artifacts(docs: DataFrame) -> DataFrame:
    """Keys of short edge lines that recur on two or three pages of a book, with the number of pages.

    Rows of (source, doc_id, text), a row a page; its doc_id tells a page from others as well as its number would.
    """
    key = T.running_key(F.col("line"))
    words = F.size(F.filter(F.split("key", f"{T.SPACE}+"), lambda w: w != ""))
    compact = F.regexp_replace("key", f"{T.SPACE}+", "")
    cjk = compact.rlike("[㐀-鿿぀-ヿ]")
    # keys are made of short lines alone
    short = docs.select("source", "doc_id", F.explode(F.filter(edge_lines(F.col("text")), lambda x: F.length(x) <= SHORT)).alias("line"))
    rows = short.withColumn("key", key).withColumn("words", words)
    fit = (F.col("key") != "") & (F.col("words") <= 8) & ~T.is_chapter_heading(F.col("line"))
    fit &= (F.col("words") != 1) | (F.length(compact) >= 6) | (cjk & (F.length(compact) >= 2))
    fit &= ~F.col("key").rlike(r"(?i)^(?:\d{1,4}|[ivxlcdm]{1,6})$")
    found = rows.where(fit).groupBy("source", "key", "words").agg(F.count_distinct("doc_id").alias("pages"))
    return found.where(F.col("pages") >= F.when((F.length("key") >= 12) | (F.col("words") >= 3), 2).otherwise(3)).select("source", "key", "pages")


def strip_running_artifacts(docs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Pages without running lines at their edges and page numbers within two lines of one; counts of both.

    A page's edges meet the book's keys by key, so it gets its own alone, six at most, however many the book has. A page is told
    by source, id and its text's hash, nulls being values; of pages alike in all three the text is the same.
    """
    mark = ["source", "doc_id", "print"]
    docs = docs.select("source", "doc_id", "text", F.xxhash64("text").alias("print"))
    edges = docs.select(*mark, F.explode(F.transform(F.filter(edge_lines(F.col("text")), lambda x: ~x.rlike(LONG)), T.running_key)).alias("key"))
    met = edges.join(artifacts.select("source", "key").distinct(), ["source", "key"]).groupBy(*mark).agg(F.collect_set("key").alias("keys"))
    met = met.select(*(F.col(c).alias(f"_{c}") for c in mark), "keys")
    same = F.lit(True)
    for c in mark:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = docs.join(met, same, "left").withColumn("rows", F.split(T.unix_lines(F.col("text")), "\n"))
    at = F.filter(F.transform("rows", lambda x, i: F.when(T.strip(x) != "", i)), lambda i: i.isNotNull())
    # pages without running lines stay as they are
    rows = rows.withColumn("at", F.when(F.col("keys").isNull() & F.col("text").isNotNull(), F.array().cast("array<int>")).otherwise(at))
    edge = F.array_union(F.slice("at", 1, 3), F.slice("at", F.greatest(F.size("at") - 2, F.lit(1)), F.lit(3)))
    rows = rows.withColumn("edge", edge)
    line = lambda i: F.element_at("rows", (i + 1).cast("int"))
    rows = rows.withColumn("artifacts", F.filter("edge", lambda i: F.coalesce(F.array_contains("keys", T.running_key(line(i))), F.lit(False))))
    number = lambda i: line(i).rlike(r"(?i)^\s*(?:\d{1,4}|[ivxlcdm]{1,6})[.!]?\s*$")
    rows = rows.withColumn("numbers", F.filter("edge", lambda i: number(i) & F.exists("artifacts", lambda a: F.abs(a - i) <= 2)))
    kept = F.filter(F.transform("rows", lambda x, i: F.when(~F.array_contains(F.array_union("artifacts", "numbers"), i), x)), lambda x: x.isNotNull())
    text = F.when(F.size("artifacts") == 0, T.unix_lines(F.col("text"))).otherwise(F.array_join(kept, "\n"))
    return rows.select("source", "doc_id", text.alias("text"), F.size("artifacts").alias("n_artifacts"), F.size("numbers").alias("n_numbers"))


#: Classes of pages that are cleaned for publication.
CLEANED = ["body", "toc", "index", "appendix"]


def clean_pairs(pairs: DataFrame) -> DataFrame:
    """Source and target texts of pages (source, doc_id, page_class, chapter_boundary, text, target), each side a row of
    (side, source, doc_id, text, n_artifacts, n_numbers), without the running lines of its side.

    Lines are discovered on pages of the cleaned classes that open no chapter, and taken off all pages of those classes;
    other pages stay as they are. A null target has no row.
    """
    sides = F.array(F.struct(F.lit("source").alias("side"), F.col("text").alias("text")), F.struct(F.lit("target").alias("side"), F.col("target").alias("text")))
    rows = pairs.select("source", "doc_id", F.col("page_class").isin(CLEANED).alias("fit"), (~F.col("chapter_boundary")).alias("plain"), F.explode(sides).alias("s")).where("s.text is not null")
    # a side of a book is a book of its own to the rules on lines
    rows = rows.select(F.concat_ws("\u0001", "s.side", "source").alias("source"), "doc_id", "s.text", "fit", "plain")
    fit = rows.where("fit")
    cleaned = strip_running_artifacts(fit.select("source", "doc_id", "text"), running_artifacts(fit.where("plain")))
    zero = F.lit(0).alias
    left = rows.where("not fit").select("source", "doc_id", "text", zero("n_artifacts"), zero("n_numbers"))
    out = cleaned.select("source", "doc_id", "text", "n_artifacts", "n_numbers").unionByName(left)
    parts = F.split("source", "\u0001", 2)
    return out.select(parts[0].alias("side"), parts[1].alias("source"), "doc_id", "text", "n_artifacts", "n_numbers")


def marked(docs: DataFrame) -> DataFrame:
    """Numbered pages (source, doc_id, print, page, marks), the text reduced to the marks of its edges and to a hash, which
    tells rows of one id apart."""
    return numbered_pages(docs.select("source", "doc_id", F.xxhash64("text").alias("print"), T.edge_marks(F.col("text")).alias("marks")), ties=("print",))


def page_edges(docs: DataFrame) -> DataFrame:
    """Each page with the next of its book: relation and continuation; the last edge is open."""
    both = beside(marked(docs), "page", "marks")
    here, there = F.col("marks"), F.col("next.marks")
    return both.select(
        "source", "page", F.col("next.page").alias("next_page"), T.marks_relation(here, there).alias("relation"),
        F.coalesce(T.marks_continue(here, there), F.lit(False)).alias("continues"),
    )


def islands(rows: DataFrame, by: str, order: str, starts: Column) -> DataFrame:
    """Adds island, numbered from 1 in each ``by``: a new one begins where ``starts`` holds."""
    return rows.withColumn("island", F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def block_starts(docs: DataFrame) -> DataFrame:
    """(source, doc_id, print, page, block): the page at which each page's block starts. Edges link neighbours only, so blocks
    are runs of pages."""
    rows = beside(marked(docs), "marks", step=-1, name="before")
    joins = T.marks_relation(F.col("before.marks"), F.col("marks")) == "continue"
    starts = F.coalesce(~joins, F.lit(True)) | F.col("before.marks").isNull() | F.col("marks").isNull()
    return running(rows, F.when(starts, F.col("page")), "block").select("source", "doc_id", "print", "page", "block")


def block_texts(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` once, as (source, page, block, text).

    Texts travel once to their row and once to their block, never by book. A row is told by source, id and its text's hash,
    nulls being values; of rows alike in all three the text is the same.
    """
    mark = ["source", "doc_id", "print"]
    held = docs.select("source", "doc_id", F.xxhash64("text").alias("print"), "text").dropDuplicates(mark)
    held = held.select(*(F.col(c).alias(f"_{c}") for c in mark), "text")
    same = F.lit(True)
    for c in mark:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return block_starts(docs).join(held, same).select("source", "page", "block", "text")


def logical_blocks(docs: DataFrame) -> DataFrame:
    """Runs of pages whose edges continue, as one text joined by spaces: edges link neighbours only, so components are runs.

    Every row is in one block, whatever its id; books of a null source are one book. Null texts count as fragments without text.
    """
    parts = F.array_sort(F.collect_list(F.struct("page", T.strip(F.col("text")).alias("text"))))
    blocks = block_texts(docs).groupBy("source", "block").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("fragments"), parts.alias("parts"))
    text = F.array_join(F.col("parts.text"), " ")
    return blocks.select("source", "first_page", "last_page", "fragments", F.length(text).alias("chars"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def joined_blocks(docs: DataFrame) -> DataFrame:
    """As ``logical_blocks``, each edge with a join of its own: a hyphen at the page's end goes where a small letter follows
    and stays before others, all else is joined by a space."""
    parts = F.array_sort(F.collect_list(F.struct("page", F.coalesce(T.strip(F.col("text")), F.lit("")).alias("text"))))

    def step(a: Column, x: Column) -> Column:
        hyphen = a.endswith("-")
        operation = F.when(hyphen & x["text"].rlike(r"^\p{Ll}"), "remove_layout_hyphen").when(hyphen, "preserve_lexical_hyphen").otherwise("insert_space")
        return F.when(a == "", x["text"]).when(x["text"] == "", a).otherwise(T.apply_join(a, x["text"], operation))

    blocks = block_texts(docs).groupBy("source", "block").agg(F.min("page").alias("first_page"), F.count("*").alias("fragments"), parts.alias("parts"))
    text = F.aggregate("parts", F.lit(""), step)
    return blocks.select("source", "first_page", "fragments", F.length(text).alias("chars"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def bridges(pages: DataFrame, body: Column, longest: int = 10) -> DataFrame:
    """Neighbouring body pages with other pages between them: how many, and whether the gap is too long."""
    w = Window.partitionBy("source").orderBy("page")
    edges = pages.where(body).select("source", F.col("page").alias("from_page"), F.lead("page").over(w).alias("to_page")).where("to_page - from_page > 1")
    return edges.select("source", "from_page", "to_page", (F.col("to_page") - F.col("from_page") - 1).alias("between"), (F.col("to_page") - F.col("from_page") > longest).alias("too_far"))


def carry_batches(pages: DataFrame, size: int = 10, overlap: int = 1) -> DataFrame:
    """Overlapping batches of pages: rows of (source, batch, page, carried), carried for pages the batch before has too."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the batch")
    stride = size - overlap
    last = Window.partitionBy("source")
    batches = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("page") - size) / stride)), F.floor((F.col("page") - 1) / stride))
    rows = pages.withColumn("n", F.max("page").over(last)).select("source", "page", "n", F.explode(batches).alias("batch"))
    # a batch that would hold nothing but what the one before carries over is none
    rows = rows.where((F.col("batch") == 0) | (F.col("batch") * stride + overlap < F.col("n")))
    return rows.select("source", F.col("batch").cast("int").alias("batch"), "page", ((F.col("batch") > 0) & (F.col("page") <= F.col("batch") * stride + overlap)).alias("carried"))


def coverage_audit(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """Per book, by expected (source, first, last): missing, duplicate and discontinuous pages."""
    want = expected.select("source", F.explode(F.sequence("first", "last")).alias("page"))
    have = pages.groupBy("source", "page").agg(F.count("*").alias("n"))
    both = want.join(have, ["source", "page"], "left")
    missing = both.groupBy("source").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("duplicate"))
    w = Window.partitionBy("source").orderBy("page")
    gaps = have.withColumn("gap", F.col("page") - F.lag("page").over(w) > 1).groupBy("source").agg(F.count_if("gap").alias("gaps"))
    return missing.join(gaps, "source", "left").select("source", "missing", "duplicate", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"))


def printed_pages(pages: DataFrame, advancing: Column) -> DataFrame:
    """Printed numbers: only advancing pages count, each book from 1."""
    n = F.sum(F.when(F.col("advances"), 1).otherwise(0)).over(Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    return pages.withColumn("advances", advancing).select("source", "page", F.when(F.col("advances"), n).alias("printed"))


def text_lines(pages: DataFrame) -> DataFrame:
    return pages.select("source", "page", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))
