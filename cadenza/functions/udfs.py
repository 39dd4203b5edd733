"""The text functions for SQL users: Arrow UDFs and a table function.  DataFrame code uses the Column forms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_VOWEL = re.compile(r"[aeiou]|(?<![aeiou])r(?![aeiou])")


def register(spark: SparkSession) -> None:
    """Registers ``vowel_skeleton``, ``count_syllables`` and the table function ``internal_rhymes``."""

    @F.pandas_udf("string")
    def vowel_skeleton(text: pd.Series) -> pd.Series:
        return text.map(lambda t: "".join(_VOWEL.findall(t.lower())), na_action="ignore")

    @F.pandas_udf("int")
    def count_syllables(text: pd.Series) -> pd.Series:
        return text.map(lambda t: len(_VOWEL.findall(t.lower())), na_action="ignore").astype("Int32")

    @F.udtf(returnType="part string, times int")
    class InternalRhymes:
        def eval(self, skel: str, least: int) -> Iterator[tuple[str, int]]:
            parts = Counter(skel[a : a + m] for m in range(least, len(skel or "") // 2 + 1) for a in range(len(skel) - m + 1))
            yield from ((p, n) for p, n in parts.items() if n > 1)

    spark.udf.register("vowel_skeleton", vowel_skeleton)
    spark.udf.register("count_syllables", count_syllables)
    spark.udtf.register("internal_rhymes", InternalRhymes)
