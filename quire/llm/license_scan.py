"""Fuzzy search for short licence notices.

A notice of m characters with at most k edits holds at least one of k + 1 pieces unchanged (pigeonhole). An Aho-Corasick
automaton finds the pieces of all notices in one pass; around each, the regex library's bounded-error matching verifies the
edits and gives the span. Where two notices fit one span, the one with fewer edits stands, so that "version 1" is not read
as a misprinted "version 2".
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.text import lean, row_chunks, whole_text

#: Phrases whose exact places are counted.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices: their labels, and rivals of those above that are one or two edits away.
NOTICES = BASE | {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2": "mpl-2",
    "apache license version 1": "apache-1",
    "under the bsd license": "bsd",
    "under the isc license": "isc",
    "under the mpl license": "mpl",
    "under the gpl license": "gpl",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
}
#: Bytes of words after lower-casing: figures, letters and all of other characters; the rest are breaks.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def edits(phrase: str) -> int:
    return 1 if len(phrase) < 16 else 2


@lru_cache(1)
def _seeds() -> tuple[ahocorasick.Automaton, dict[str, regex.Pattern]]:
    pieces: dict[str, list[tuple[str, int]]] = {}
    for phrase in NOTICES:
        k = edits(phrase)
        cuts = [len(phrase) * i // (k + 1) for i in range(k + 2)]
        for a, b in zip(cuts, cuts[1:]):
            pieces.setdefault(phrase[a:b], []).append((phrase, a))
    automaton = ahocorasick.Automaton()
    for piece, uses in pieces.items():
        automaton.add_word(piece, (len(piece), uses))
    automaton.make_automaton()
    return automaton, {p: regex.compile(rf"(?b)(?<= )(?:{regex.escape(p)}){{e<={edits(p)}}}(?= )") for p in NOTICES}


def notices(joined: str) -> list[tuple[int, int, str, int]]:
    """(start, end, phrase, edits) in words joined by spaces, with one before and after."""
    automaton, patterns = _seeds()
    regions: dict[str, list[list[int]]] = {}
    for end, (size, uses) in automaton.iter(joined):
        start = end + 1 - size
        for phrase, offset in uses:
            k = edits(phrase)
            low, high = max(0, start - offset - k - 1), start - offset + len(phrase) + k + 1
            known = regions.setdefault(phrase, [])
            if known and low <= known[-1][1]:
                known[-1][1] = max(high, known[-1][1])
            else:
                known.append([low, high])
    found = []
    for phrase, spans in regions.items():
        search = patterns[phrase].search
        for low, high in spans:
            # the best match of a stretch comes first; then what lies on either side of it is searched
            todo = [(low, min(high, len(joined)))]
            while todo:
                a, b = todo.pop()
                # one character before and behind a match is read as well
                m = search(joined, a, b) if b - a >= len(phrase) - edits(phrase) else None
                if m:
                    found.append((m.start(), m.end(), phrase, sum(m.fuzzy_counts)))
                    todo += [(a, m.start()), (m.end() - 1, b)]
    found.sort(key=lambda f: (f[3], f[0], f[1], f[2]))
    # those kept lie apart: in order of place each is held against its two neighbours alone
    kept: list[tuple[int, int, str, int]] = []
    for f in found:
        at = bisect.bisect(kept, f)
        if (not at or kept[at - 1][1] <= f[0]) and (at == len(kept) or kept[at][0] >= f[1]):
            kept.insert(at, f)
    return kept


def scanned(raw: bytes) -> tuple[int, list[dict], list[dict]]:
    """Number of words, exact places of the base phrases, and notices of a text, places in words."""
    words = raw.translate(WORDS).split()
    joined = b" " + b" ".join(words) + b" "
    # word n starts behind space n
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    word = lambda at: int(np.searchsorted(spaces, at))
    base = []
    for phrase, label in BASE.items():
        needle = f" {phrase} ".encode()
        at = joined.find(needle)
        while at >= 0:
            base.append({"label": label, "word": word(at)})
            at = joined.find(needle, at + 1)
    found, text = [], joined.decode()
    # edits are of characters, so notices stand at places in characters
    if len(text) != len(joined):
        spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32)
    for start, end, phrase, k in notices(text):
        found.append({"label": NOTICES[phrase], "first_word": word(start) - 1, "end_word": word(end), "edits": k, "likeness": 1 - k / len(phrase)})
    return len(words), base, found


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "base", "found"]
    base_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    found_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32()), ("likeness", pa.float64())]))
    for batch in batches:
        for part in row_chunks(batch, "bytes"):
            rows = [scanned(raw.as_py()) for raw in part.column("bytes")]
            n_words, bases, founds = zip(*rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(bases, base_type), pa.array(founds, found_type)], names)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (columns used: doc_id, text): doc_id, n_words, base (label and first word of each exact
    phrase) and found (label, words first to end exclusive, edits, likeness of each notice with up to two edits, of characters).

    Null and empty texts have no words and no notices; null and repeated doc_ids pass through. Where notices overlap, the one
    with fewer edits is reported, of as many the earlier. No rows, no result; other columns are ignored.
    """
    texts = lean(docs).select("doc_id", whole_text().alias("bytes"))
    schema = "doc_id long, n_words long, base array<struct<label:string,word:long>>, found array<struct<label:string,first_word:long,end_word:long,edits:int,likeness:double>>"
    return texts.mapInArrow(_scanned, schema)


def query(spark, sf_dir: str) -> DataFrame:
    from quire.llm.text import table

    out = license_scan(table(spark, sf_dir, "documents"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    exact = F.when(F.size("base") > 0, 1.0).otherwise(0.0)
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"), joined(F.concat("base.label", "found.label")).alias("labels"), F.greatest(exact, F.coalesce(F.array_max("found.likeness"), F.lit(0.0))).alias("score"),
    )
