"""An index that proposes pairs of names which may be alike, and loses none that are."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters from the rarest on; any order gives the same pairs.
RARE_FIRST = "qxjzwvfkybhgmpudclotnrsiea"


def keys(name: str, least: float, left: bool) -> list[str]:
    """The index keys of a plain name. Letters: with as many as `least` leaves over, rarest first, two names share one if the letters
    that match are `least` of both (matching letters are twice counted, so no fewer than least / (2 - least) of a name's own match).
    Neighbouring characters, ends of words included. A name of one letter meets all that have it."""
    seen: dict[str, int] = {}
    letters = []
    for c in sorted(name, key=lambda c: (RARE_FIRST.find(c), c)):
        seen[c] = seen.get(c, 0) + 1
        letters.append(f"{c}{seen[c]}")
    kept = letters[: len(letters) - math.ceil(len(letters) * least / (2 - least) - 1e-9) + 1]
    text = f" {name} "
    single = ("<" if left else ">") if len(name) == 1 else (">" if left else "<")
    return list({*kept, *(text[i : i + 2] for i in range(len(text) - 1)), *(single + c for c in set(name))})


def proposed(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(sport, a, b): of names (sport, name), distinct and not empty, the pairs that share a key of the index."""

    def indexed(names: DataFrame, is_left: bool) -> DataFrame:
        @F.pandas_udf(T.ArrayType(T.StringType()))
        def of(x: pd.Series) -> pd.Series:
            return pd.Series([keys(n, least, is_left) for n in x], dtype=object)

        return names.where("name <> ''").distinct().select("sport", "name", F.explode(of("name")).alias("key"))

    a, b = indexed(left, True).withColumnRenamed("name", "a"), indexed(right, False).withColumnRenamed("name", "b")
    return a.join(b, ["sport", "key"]).select("sport", "a", "b").distinct()
