"""Sequence similarity: the one text rule without a built-in form."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, False).ratio() for x, y in zip(a, b)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """Twice the matched characters over both lengths, of lower-case letters and figures; null with a null side.

    Quadratic in the lengths: compare what filters leave, not all pairs.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    return _ratio(bare(a), bare(b))


@F.pandas_udf(StringType())
def _nfkc(c: pd.Series) -> pd.Series:
    return c.str.normalize("NFKC").str.casefold()


def quality_text(c: Column) -> Column:
    """Text as translations are compared: no note references, compatibility forms, case folded, single spaces."""
    from quire.functions.text import NOTE, SPACE, strip

    return strip(F.regexp_replace(_nfkc(F.regexp_replace(c, NOTE, "")), f"{SPACE}+", " "))


def fidelity(source: Column, target: Column, source_language: Column, target_language: Column, terms: Column | None = None) -> Column:
    """Code of what is wrong with a translation, or null: source_echo, protected_term_changed, source_script_leak or
    target_script_absent. A text that is itself a protected term may stay as it is."""
    from quire.functions.text import strip

    a, b = quality_text(source), quality_text(target)
    own = changed = F.lit(False)
    if terms is not None:
        # all terms in one call; no text holds the sign between them
        plain = F.transform(F.split(_nfkc(F.array_join(terms, "\x01")), "\x01"), strip)
        own = F.array_contains(plain, a)
        alone = lambda t, more, flags: F.concat(F.lit(f"{flags}(?<![A-Za-z])\\Q"), t, F.lit(f"\\E{more}(?![A-Za-z])"))
        # what a pandas UDF gives can't be named inside a lambda: it goes in beside each term
        beside = F.arrays_zip(terms.alias("t"), F.array_repeat(a, F.size(terms)).alias("a"))
        changed = F.exists(beside, lambda z: F.regexp_like(z["a"], alone(z["t"], "", "(?iu)")) & ~F.regexp_like(target, alone(z["t"], "(?:['’]s|s)?", "")))
    script = lambda c: F.regexp_count(c, F.lit("[㐀-䶿一-鿿぀-ヿ]"))
    latin, east = ["en", "fr", "de", "es"], ["zh-Hans", "ja"]
    leak = target_language.isin(*latin) & source_language.isin(*east) & (script(a) >= 8) & (script(b) >= F.greatest(F.lit(6), F.floor(script(a) / 2)))
    absent = target_language.isin(*east) & source_language.isin(*latin) & (F.regexp_count(a, F.lit(r"\p{L}")) >= 20) & (script(b) == 0)
    code = F.when(own & (a == b), None).when((F.length(a) >= 4) & (a == b), "source_echo").when(changed, "protected_term_changed").when(leak, "source_script_leak").when(absent, "target_script_absent")
    return F.when(source_language != target_language, code)
