"""Word-level edit distance as an Arrow-batched helper (Spark has only the character form)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def edit_distance(ref, hyp) -> int:
    """Insertions, deletions and substitutions between two word sequences."""
    codes: dict[str, int] = {}
    r = [codes.setdefault(w, len(codes)) for w in ref]
    h = np.array([codes.setdefault(w, len(codes)) for w in hyp], dtype=np.int64)
    steps = np.arange(len(h) + 1)
    row = steps.copy()
    for i, word in enumerate(r, start=1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (h != word))
        # insertions run left to right: a running minimum after removing the slope
        row = np.minimum.accumulate(best - steps) + steps
    return int(row[-1])


@F.pandas_udf(T.IntegerType())
def word_errors(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(r, h) for r, h in zip(ref, hyp)], dtype="int32")
