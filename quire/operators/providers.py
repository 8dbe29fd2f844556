"""Providers of translations: batches of units in, the same units out, with the contract checked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Translate = Callable[[list[str]], list[str]]


def mock(text: Column) -> Column:
    """The stand-in provider: it proves routing, not translation."""
    return F.concat(F.lit("[mock] "), text)


def run_provider(units: DataFrame, translate: Translate, batch: int = 8) -> DataFrame:
    """unit, translated and error for units of (unit, text), ``batch`` at a time.

    A batch that raises or comes back with another length is an error of each of its units; later batches go on.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done: list[str | None] = []
            wrong: list[str | None] = []
            for low in range(0, len(frame), batch):
                texts = frame["text"].iloc[low : low + batch].tolist()
                try:
                    out = translate(texts)
                    if len(out) != len(texts):
                        raise ValueError("as many texts must come back as went in")
                    done += out
                    wrong += [None] * len(texts)
                except Exception as e:  # noqa: BLE001  whatever a provider raises is the unit's error
                    done += [None] * len(texts)
                    wrong += [f"{type(e).__name__}: {e}"] * len(texts)
            yield pd.DataFrame({"unit": frame["unit"], "translated": done, "error": wrong})

    return units.select("unit", "text").mapInPandas(run, "unit long, translated string, error string")


def retry_delay(attempt: Column, status: Column) -> Column:
    """Seconds to wait before the next attempt; null where a retry is no use."""
    fit = status.isNull() | status.isin(408, 409, 429) | (status >= 500)
    return F.when(fit, F.least(F.lit(30.0), F.pow(F.lit(2.0), attempt)))
