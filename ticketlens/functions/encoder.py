"""Optional sentence-encoder hook (M9 re-aim).

The reference encodes text with a local transformer network. Here the
embedding is normally a precomputed column; a caller that has an encoder
can plug it in with ``encoder_column``: an iterator Pandas UDF that loads
the model once per task and encodes Arrow batches (``batch_size`` rows
per call, 64 in the reference).
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encoder_column(text: Column, load: Callable[[], Callable[[list], list]], batch_size: int = 64) -> Column:
    """``load()`` returns ``encode(list[str]) -> list[list[float]]``."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()                       # once per task
        for s in batches:
            texts = s.fillna("").tolist()
            out = []
            for i in range(0, len(texts), batch_size):
                out.extend(model(texts[i:i + batch_size]))
            yield pd.Series(out)

    return encode(text)
