"""Documents in normal form, with the numbers and dates that their texts hold: one call for all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions import values as V


def normalised(docs: DataFrame, most: int | None = None) -> DataFrame:
    """docs (doc_id, text, ...) with normalized (case kept), normalized_lower, numbers and dates of the text; a null text is empty.

    numbers: array of struct(start, end, raw, number); dates: array of date, in the order of the text. most: of
    either so many at most; by default all.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    dates = V.dates_in(text)
    return docs.withColumns({
        "normalized": T.normalize(text, lower=False),
        "normalized_lower": T.normalize(text),
        "numbers": V.numbers_in(text, most),
        "dates": dates if most is None else F.slice(dates, 1, most),
    })
