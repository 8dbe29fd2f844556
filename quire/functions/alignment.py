"""Texts held against each other: where pages begin in a unit, markers in its translation, and what one text has more than another."""

from __future__ import annotations

import bisect
import heapq
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from quire.functions import text as T

#: The words of a needle, the fewest, and how many of a page's first words may be skipped.
NEEDLE, FEWEST, SKIPS = 6, 3, 4
#: A word as Unicode has letters and figures.
WORD = r"[\p{L}\p{N}_]+"
BETWEEN = "\x01"
OFFSETS = "array<struct<place:int,offset:int,accuracy:string>>"


def page_offsets(source: Column, pages: Column) -> Column:
    """Where the pages of a unit begin in its text: array of (place, offset, accuracy) for all pages but the first.

    ``pages`` are their own texts in order. A page begins where its first words stand, no earlier than the page before: six
    words, fewer at its end but three at least ("exact_token"); else the words from its second, third or fourth on
    ("nearest_token"); else at its share of the text ("proportional"). Words are compared in lower case. Null pages are without words; a
    unit of fewer than two pages has none, a null text gives null.
    """
    folded = lambda c: F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    words = lambda c: F.regexp_extract_all(c, F.lit(WORD), F.lit(0))
    line = lambda tokens: F.concat(F.lit(BETWEEN), F.array_join(tokens, BETWEEN), F.lit(BETWEEN))
    parts = F.struct(words(source).alias("words"), F.split(source, WORD, -1).alias("gaps"), line(words(folded(source))).alias("line"))

    def offset(s: Column, at: Column) -> Column:
        """The character at which the word begins that stands at a place of the line."""
        before = F.substring(s["line"], F.lit(1), at - 1)
        n = F.length(before) - F.length(F.replace(before, F.lit(BETWEEN), F.lit("")))
        total = lambda a, k: F.aggregate(F.slice(a, F.lit(1), k), F.lit(0), lambda t, x: t + F.length(x))
        return total(s["words"], n) + total(s["gaps"], n + 1)

    def found(s: Column, page: Column, cursor: Column) -> Column:
        """The first needle that occurs: (skip, at); at is 0 if none does."""
        own = words(folded(F.coalesce(page, F.lit(""))))

        def one(own: Column, skip: Column) -> Column:
            needle = F.slice(own, skip + 1, F.lit(NEEDLE))
            fit = (skip < F.size(own)) & (F.size(needle) >= FEWEST)
            return F.struct(skip.alias("skip"), F.when(fit, F.call_function("locate", line(needle), s["line"], cursor)).otherwise(0).alias("at"))

        tried = T.let(own, lambda own: F.filter(F.transform(F.sequence(F.lit(0), F.lit(SKIPS - 1)), lambda k: one(own, k)), lambda f: f["at"] > 0))
        return F.coalesce(F.get(tried, F.lit(0)), F.struct(F.lit(-1).alias("skip"), F.lit(0).alias("at")))

    def all_of(s: Column) -> Column:
        start = F.struct(F.lit(1).alias("cursor"), F.array().cast(OFFSETS).alias("out"))

        def step(a: Column, place: Column) -> Column:
            def placed(f: Column) -> Column:
                share = F.bround(F.length(source).cast("long") * place / F.size(pages), 0).cast("int")
                accuracy = F.when(f["at"] == 0, "proportional").when(f["skip"] == 0, "exact_token").otherwise("nearest_token")
                here = F.struct(place.alias("place"), F.when(f["at"] > 0, offset(s, f["at"])).otherwise(share).alias("offset"), accuracy.alias("accuracy"))
                return F.struct(F.when(f["at"] > 0, f["at"]).otherwise(a["cursor"]).alias("cursor"), F.array_append(a["out"], here).alias("out"))

            return T.let(found(s, F.get(pages, place), a["cursor"]), placed)

        return F.aggregate(F.sequence(F.lit(1), F.size(pages) - 1), start, step, lambda a: a["out"])

    return F.when(source.isNotNull(), F.when(F.size(pages) >= 2, T.let(parts, all_of)).otherwise(F.array().cast(OFFSETS)))


def with_markers(text: Column, offsets: Column, source_length: Column, labels: Column) -> Column:
    """A translation with the page markers of its source: struct(text, placed).

    Each page of ``offsets`` with a label (``labels``: array by place) goes to the sentence end nearest to its share of the text, the earlier
    of two as near; without any to that share itself. placed: array of (place, offset, accuracy).
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
    step = lambda a, x: T.let(a["at"] + F.length(x) + 1, lambda at: F.struct(at.alias("at"), F.array_append(a["ends"], at).alias("ends")))

    def ends(text: Column) -> Column:
        """Where sentences end, found in one pass: behind all pieces but the last."""
        pieces = F.split(F.coalesce(text, F.lit("")), "[。！？；]", -1)
        return T.let(pieces, lambda p: F.aggregate(F.slice(p, F.lit(1), F.size(p) - 1), start, step, lambda a: a["ends"]))

    def nearest(u: Column, raw: Column) -> Column:
        """The end nearest to a place, the earlier of two as near: by bisection."""
        bounds = F.struct(F.lit(0).alias("low"), F.size(u["ends"]).alias("high"))

        def halved(a: Column) -> Column:
            mid = F.shiftright(a["low"] + a["high"], 1)
            below = F.get(u["ends"], mid) < raw
            return F.when(a["low"] >= a["high"], a).when(below, F.struct((mid + 1).alias("low"), a["high"].alias("high"))).otherwise(F.struct(a["low"].alias("low"), mid.alias("high")))

        # 31 halvings do for any array
        first = F.aggregate(F.sequence(F.lit(1), F.lit(31)), bounds, lambda a, _: halved(a), lambda a: a["low"])
        around = lambda i: F.array_min(F.transform(F.filter(F.array(F.get(u["ends"], i - 1), F.get(u["ends"], i)), lambda e: e.isNotNull()), lambda e: F.struct(F.abs(e - raw).alias("away"), e.alias("at"))))
        return T.let(first, around)

    def one(u: Column, o: Column) -> Column:
        raw = F.bround(u["n"].cast("long") * o["offset"] / F.greatest(u["source_length"], F.lit(1)), 0).cast("int")
        near = T.let(raw, lambda raw: F.struct(raw.alias("raw"), nearest(u, raw)["at"].alias("at")))
        return T.let(near, lambda p: F.struct(o["place"].alias("place"), F.coalesce(p["at"], p["raw"]).alias("offset"), F.when(p["at"].isNull(), "proportional").otherwise("nearest_sentence").alias("accuracy")))

    def placed(u: Column) -> Column:
        return F.transform(F.filter(u["offsets"], lambda o: F.get(u["labels"], o["place"]).isNotNull()), lambda o: one(u, o))

    def inserted(u: Column, p: Column) -> Column:
        """Marks and the pieces of text between them, in order."""
        marks = F.array_sort(F.transform(p, lambda x: F.struct(x["offset"].alias("at"), F.concat(F.lit("\n\n【"), F.get(u["labels"], x["place"]), F.lit("】\n\n")).alias("mark"))))
        before = lambda m, i: F.when(i > 0, F.get(m, i - 1)["at"]).otherwise(0)
        piece = lambda m, x, i: F.concat(F.substring(u["text"], before(m, i) + 1, x["at"] - before(m, i)), x["mark"])
        rest = lambda m: F.substring(u["text"], F.coalesce(F.get(m, F.size(m) - 1)["at"], F.lit(0)) + 1, u["n"])
        return T.let(marks, lambda m: F.concat(F.array_join(F.transform(m, lambda x, i: piece(m, x, i)), ""), rest(m)))

    # given columns may be whole expressions, so each is computed once, before what is done for every page
    unit = F.struct(text.alias("text"), offsets.alias("offsets"), source_length.alias("source_length"), labels.alias("labels"))
    read = lambda u: F.struct(*(u[c].alias(c) for c in ("text", "offsets", "source_length", "labels")), F.length(u["text"]).alias("n"), ends(u["text"]).alias("ends"))
    return T.let(unit, lambda u: T.let(read(u), lambda u: T.let(placed(u), lambda p: F.struct(inserted(u, p).alias("text"), p.alias("placed")))))


#: Characters of both sides, multiplied, up to which the library's own search is the faster one.
SMALL = 1 << 14


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """The longest string that both hold: where it stands first in a, and in b, and its length."""
    base = np.uint64(0x9E3779B97F4A7C15)
    n = max(len(a), len(b))
    powers = np.cumprod(np.full(n + 1, base, np.uint64)) * np.uint64(pow(int(base), -1, 1 << 64))
    # sums of characters times powers; a run's sum, moved to the highest power, is its hash
    sums = [np.r_[np.uint64(0), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * powers[: len(x)])] for x in (a, b)]

    def runs(k: int) -> list[np.ndarray]:
        return [(s[k:] - s[:-k]) * powers[n - np.arange(len(s) - k)] for s in sums]

    low, high, best = 0, min(len(a), len(b)), (0, 0, 0)
    while low < high:
        k = (low + high + 1) // 2
        left, right = runs(k)
        hit = np.flatnonzero(np.isin(left, right))
        if len(hit):
            i = int(hit[0])
            best, low = (i, int(np.flatnonzero(right == left[i])[0]), k), k
        else:
            high = k - 1
    return best


#: Characters of the shortest runs that are listed first, how many runs are listed at most, and how many of them are looked at one by one.
GRAM, RUNS, CLOSER = 8, 1 << 19, 1 << 14
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]
Part = tuple[int, int, int, int]


def _names(z: np.ndarray, letters: int, g: int) -> tuple[np.ndarray, int]:
    """Numbers of the strings of g characters that begin at each place, equal for equal strings alone, and a bound of them."""
    n, size = 1, letters
    while n < g:
        step = min(n, g - n)
        if size >= 1 << 31:
            z = np.unique(z, return_inverse=True)[1]
            size = int(z.max()) + 1
        z = z[:-step] * size + z[step:]
        n, size = n + step, size * size
    if size >= (1 << 62) // (letters + 2):
        z = np.unique(z, return_inverse=True)[1]
        size = int(z.max()) + 1
    return z, size


def _edges(left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray, sides: int) -> np.ndarray | None:
    """Places of strings that both hold, where what stands beside them (x and y, below ``sides``) differs: sorted keys of diagonal and
    place in the left one. None if there are more than RUNS."""
    n, keys = len(left), np.concatenate((left * sides + x, right * sides + y))
    order = np.argsort(keys)
    keys, ours = keys[order], order < n
    theirs = np.zeros(len(keys) + 1, np.int64)
    np.cumsum(~ours, out=theirs[1:])

    def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of the left string's places in order, how many of the right one's come before its key, and up to it."""
        begins = np.empty(len(keys) + 1, bool)
        begins[0] = begins[-1] = True
        np.not_equal(keys[1:], keys[:-1], out=begins[1:-1])
        before, group = theirs[begins], (np.cumsum(begins[:-1]) - 1)[ours]
        return before[group], before[group + 1]

    low, high = counted(keys // sides)
    # those of the same string that have the same beside them are left out
    upto, since = counted(keys)
    i, order = order[ours], order[~ours] - n
    i, begin, count = map(np.concatenate, ((i, i), (low, since), (upto - low, high - since)))
    keep = count > 0
    i, begin, count = i[keep], begin[keep], count[keep]
    total = int(count.sum())
    if total > RUNS:
        return None
    j = order[np.arange(total) + np.repeat(begin - np.cumsum(count) + count, count)]
    i = np.repeat(i, count)
    out = (j - i + len(left)) * (len(left) + len(right)) + i
    out.sort()
    return out


def _runs_of(x: np.ndarray, y: np.ndarray, letters: int, g: int) -> Runs | None:
    """All runs of g characters or more that both hold and that go no further: where they begin in x, in y, and their lengths. None if
    there are more than RUNS; places within runs are not listed."""
    names, size = _names(np.concatenate((x, y)), letters, g)
    left, right = names[: len(x) - g + 1], names[len(x) :]
    # nothing stands beside the first and the last character, which is unlike anything
    ours, theirs = [letters], [letters + 1]
    starts = _edges(left, right, np.concatenate((ours, x[: len(left) - 1])), np.concatenate((theirs, y[: len(right) - 1])), letters + 2)
    if starts is None:
        return None
    ends = _edges(left, right, np.concatenate((x[g:], ours)), np.concatenate((y[g:], theirs)), letters + 2)
    # the starts and ends of a diagonal take turns
    i = starts % (len(left) + len(right))
    return i, starts // (len(left) + len(right)) - len(left) + i, ends - starts + g


def _runs(x: np.ndarray, y: np.ndarray, letters: int, below: int) -> tuple[int, Runs | None]:
    """The runs of g characters or more, and g: ``GRAM``, or less if all are known to be below that, or as many as leave no more than RUNS
    of them. None if runs of that length alone are more."""
    g = GRAM if below > GRAM else below // 2
    none = np.empty(0, np.int64)
    low, high = g - 1, min(below, len(x) + 1, len(y) + 1)
    if g >= high:
        return g, (none, none, none)
    least = g
    while low < g < high:
        runs = _runs_of(x, y, letters, g)
        if runs is None:
            low, g = g, min(2 * g, (g + high) // 2)
        elif len(runs[0]) or g == least:
            return g, runs
        else:
            high, g = g, (low + g) // 2
    return high, None


def _cut(runs: Runs, part: Part, least: int) -> tuple[list[tuple[int, int, int]], list[Part]]:
    """The blocks of ``least`` characters or more, the longest first, and the parts between them.

    A run is cut to its part when it is its turn: what was found before is as long at least, so the run reaches into one part at most,
    that at its beginning or the next. Each run is held once, whatever the parts.
    """
    i, j, k = runs
    al, ah, bl, bh = ([v] for v in part)
    width, found, size = part[1] + 1, [], 16
    while len(k) and ah:
        low_a, high_a, low_b, high_b = map(np.array, (al, ah, bl, bh))
        p = np.searchsorted(high_a, i, "right")
        keep = p < len(ah)
        i, j, k, p = i[keep], j[keep], k[keep], p[keep]
        away = j - i
        start, end = np.maximum(np.maximum(i, low_a[p]), low_b[p] - away), np.minimum(np.minimum(i + k, high_a[p]), high_b[p] - away)
        keep = end - start >= least
        i, k, away = start[keep], (end - start)[keep], away[keep]
        j = i + away
        # the longest first, of those the first in a, and of those the first in b
        rank = (width - k) * width + i
        last = int(np.partition(rank, size)[size]) if len(rank) > size else width * width
        now = rank <= last
        heap, later = sorted(zip(rank[now].tolist(), j[now].tolist())), []
        i, j, k = i[~now], j[~now], k[~now]
        while heap:
            r, v = heapq.heappop(heap)
            u, n = r % width, width - r // width
            p = bisect.bisect_right(ah, u)
            if p == len(ah):
                continue
            start, end = max(u, al[p], bl[p] - v + u), min(u + n, ah[p], bh[p] - v + u)
            if end - start < least:
                continue
            if end - start < n:
                r, v = (width - end + start) * width + start, v - u + start
                if r <= last:
                    heapq.heappush(heap, (r, v))
                else:
                    later.append((start, v, end - start))
                continue
            found.append((u, v, n))
            sides = [s for s in ((al[p], u, bl[p], v), (u + n, ah[p], v + n, bh[p])) if s[0] < s[1] and s[2] < s[3]]
            for into, place in ((al, 0), (ah, 1), (bl, 2), (bh, 3)):
                into[p : p + 1] = [s[place] for s in sides]
        if later:
            i, j, k = (np.concatenate((old, new)) for old, new in zip((i, j, k), np.array(later).T))
        size = min(2 * size, CLOSER)
    return found, list(zip(al, ah, bl, bh))


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """The blocks of SequenceMatcher without its guess at junk, in order, adjacent ones joined; long texts do not take time in proportion
    to their product, nor memory beyond their lengths and RUNS: their common runs are listed, the longest ones alone where there are
    too many, then those of the parts between them."""
    if a == b:
        return [(0, 0, len(a))] if a else []
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4") for s in (a, b))
    letters = 0
    if len(a) * len(b) > SMALL:
        distinct, names = np.unique(np.concatenate((x, y)), return_inverse=True)
        x, y, letters = names[: len(x)], names[len(x) :], len(distinct)
    #: Parts, and what no common run of them is as long as.
    todo = [(0, len(a), 0, len(b), max(len(a), len(b)) + 1)]
    found: list[tuple[int, int, int]] = []
    while todo:
        al, ah, bl, bh, below = todo.pop()
        if al >= ah or bl >= bh or below == 1:
            continue
        parts, part = [], None
        if (ah - al) * (bh - bl) > SMALL:
            below, runs = _runs(x[al:ah], y[bl:bh], letters, below)
            if runs is not None:
                part, parts = _cut(runs, (0, ah - al, 0, bh - bl), below)
            else:
                i, j, k = _longest(x[al:ah], y[bl:bh])
                # hashes may agree by chance, if hardly ever
                if np.array_equal(x[al + i : al + i + k], y[bl + j : bl + j + k]):
                    part, parts = [(i, j, k)] if k else [], [(0, i, 0, j), (i + k, ah - al, j + k, bh - bl)] if k else []
        if part is None:
            part = SequenceMatcher(None, a[al:ah], b[bl:bh], False).get_matching_blocks()[:-1]
        found += [(al + i, bl + j, k) for i, j, k in part]
        todo += [(al + i, al + n, bl + j, bl + m, below) for i, n, j, m in parts]
    out: list[tuple[int, int, int]] = []
    for i, j, k in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + k)
        else:
            out.append((i, j, k))
    return out


def _differences(a: str, b: str, most: int, longest: int) -> tuple[float, list[str], list[str]]:
    missing, added, at, bt, same = [], [], 0, 0, 0
    for i, j, k in [*matching_blocks(a, b), (len(a), len(b), 0)]:
        for into, piece in ((missing, a[at:i]), (added, b[bt:j])):
            if piece.strip() and len(into) < most:
                into.append(piece.strip()[:longest])
        at, bt, same = i + k, j + k, same + k
    return 2 * same / (len(a) + len(b)) if a or b else 1.0, missing, added


#: A type in words would need a session where the module is imported.
COMPARED = StructType().add("similarity", DoubleType()).add("missing", ArrayType(StringType())).add("added", ArrayType(StringType()))
for _name, _type in (("punctuation", IntegerType()), ("hyphens", IntegerType()), *((_c, StringType()) for _c in ("body", "header", "number"))):
    COMPARED = COMPARED.add(_name, _type)
#: Rows of a batch whose texts are strings of Python at once.
ROWS = 64


#: Signs that are counted as punctuation.
PUNCTUATION = ".,;:!?—–-()[]{}\"'“”‘’"


def _signs(text: str) -> int:
    return sum(map(text.count, PUNCTUATION))


def _hyphens(text: str) -> int:
    """Lines that end with a hyphen, spaces aside."""
    return sum(line.rstrip().endswith("-") for line in text.splitlines()) if "-" in text else 0


def _plain(text: str) -> str:
    """In compatibility form with single spaces; what splits is T.SPACE."""
    return " ".join(unicodedata.normalize("NFKC", text).split())


@F.arrow_udf(COMPARED)
def _compared(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The differences of layer and body, their texts' and their counts', and the plain forms of body, header and number."""
    words = pa.list_(pa.string())
    kind = pa.struct([("similarity", pa.float64()), ("missing", words), ("added", words), ("punctuation", pa.int32()), ("hyphens", pa.int32()), *((c, pa.string()) for c in ("body", "header", "number"))])
    for columns in batches:
        made = [pa.array([], kind)]
        for at in range(0, len(columns[0]), ROWS):
            rows = []
            for texts in zip(*(c.slice(at, ROWS).to_pylist() for c in columns)):
                layer, *others = map(_plain, texts)
                counts = (abs(f(texts[0]) - f(texts[1])) for f in (_signs, _hyphens))
                rows.append((*_differences(layer, others[0], 12, 160), *counts, *others))
            made.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], fields=list(kind)))
        yield pa.concat_arrays(made)


def compared(body: Column, layer: Column, header: Column, number: Column, orders: Column) -> Column:
    """A page's recognised body against its text layer: struct(body_chars, layer_chars, similarity, missing, added,
    header_in_body, number_in_body, order_reasonable, punctuation, hyphens).

    Similarity (six places) and fragments are those of the texts in compatibility form with single spaces: what the layer has and
    the body misses, and the other way round, twelve of each at most, 160 characters each, as the rule has it. ``orders`` are
    the places of the body's blocks. punctuation and hyphens (at line ends) are differences of counts. Nulls are empty texts.
    """
    body, layer = F.coalesce(body, F.lit("")), F.coalesce(layer, F.lit(""))
    found = _compared(layer, body, F.coalesce(header, F.lit("")), F.coalesce(number, F.lit("")))
    low = lambda name: F.replace(F.lower(found[name]), F.lit("ß"), F.lit("ss"))
    within = lambda name: (low(name) != "") & F.contains(low("body"), low(name))
    return F.struct(
        F.length(body).alias("body_chars"), F.length(layer).alias("layer_chars"), F.round(found["similarity"], 6).alias("similarity"), found["missing"].alias("missing"), found["added"].alias("added"),
        within("header").alias("header_in_body"), within("number").alias("number_in_body"), (orders == F.array_sort(F.array_distinct(orders))).alias("order_reasonable"), found["punctuation"].alias("punctuation"), found["hyphens"].alias("hyphens"),
    )


OCCURRENCES = "array<struct<term:string,nth:int,source_start:int,translated_start:int,before:string,after:string,action:string>>"


def literal_starts(text: str, literal: str) -> list[int]:
    """Where a literal stands in a text, from 0, without overlaps."""
    out, at = [], text.find(literal)
    while at >= 0:
        out.append(at)
        at = text.find(literal, at + len(literal))
    return out


def without_case(text: str) -> str:
    """The text with each letter that may count as an ASCII one in whatever case as its small one, character for character."""
    for other, letter in (("İ", "i"), ("ı", "i"), ("ſ", "s"), ("\u212a", "k")):
        text = text.replace(other, letter)
    return text.lower()


def _occurrences(source: str, translation: str | None, terms: list[str]) -> list[dict]:
    out, low = [], without_case(translation or "")
    for term in terms:
        there = literal_starts(low, without_case(term))
        for i, h in enumerate(literal_starts(source, term)):
            end, other = h + len(term), there[i] if i < len(there) else None
            out.append({
                "term": term, "nth": i + 1, "source_start": h, "translated_start": other, "before": source[max(h - T.AROUND, 0) : h].strip(), "after": source[end : end + T.AROUND].strip(),
                "action": "needs_span_alignment" if other is None else "confirm_translation",
            })
    return out


def term_occurrences(source: Column, translation: Column) -> Column:
    """Each occurrence of a candidate term of the source, with its number, what stands around it and where the translation has
    the term for as many times (null: nowhere), in whatever case."""

    @F.pandas_udf(OCCURRENCES)
    def found(sources: pd.Series, translations: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else _occurrences(s, t, list(w)) for s, t, w in zip(sources, translations, terms)], dtype=object)

    terms = F.array_except(F.regexp_extract_all(source, T.regex(T.TERM), F.lit(0)), F.array(*map(F.lit, T.NO_TERMS)))
    return found(source, translation, terms)
