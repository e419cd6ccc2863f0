"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (one to
three letters, words padded with a boundary mark), by rank. A document gets
the language whose profile has the least out-of-place distance to the
document's own list: the sum over the document's n-grams of how far their
ranks lie apart, and the full profile length for those the profile lacks.

Profiles are counted over every training row. Null languages, null texts and
held-out rows teach nothing. A text that is null or has no letter is `und`
with score 0, as is every text where nothing could be learned. The score is
the relative lead of the best language over the second (1 if there is none
other); ties go to the smaller name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE = 1
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: the lower-case letter, or the edge mark for what is no letter."""
    table = np.full(0x110000, EDGE, np.uint32)
    for start, stop in ((0, 0xD800), (0xE000, 0x110000)):
        for c in range(start, stop):
            if (x := chr(c)).isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
    return table


def _runs(text: str) -> np.ndarray:
    """Letters of a text between single edge marks, one at each end."""
    x = _letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int64)
    x = np.concatenate([[EDGE], x, [EDGE]])
    return x[~((x == EDGE) & (np.concatenate([[0], x[:-1]]) == EDGE))]


def _grams(x: np.ndarray) -> np.ndarray:
    """Keys of the one- to three-letter n-grams: 21 bits a letter, absent ones 0."""
    if len(x) < 3:
        return np.empty(0, np.int64)
    two = (x[:-1] << 21) | x[1:]
    three = (two[:-1] << 21) | x[2:]
    return np.concatenate([x[x != EDGE], two, three])


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.concatenate([first, [len(keys)]]))


def learn_profiles(docs: DataFrame, length: int, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """The `length` most frequent n-grams of each language, ties by key; counts cover all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                held: list[np.ndarray] = []
                size = 0
                for t in texts:
                    held.append(_runs(t))
                    size += len(held[-1])
                    if size > 1_000_000:
                        keys, n = _counted(np.concatenate([_grams(x) for x in held]))
                        yield pd.DataFrame({"lang": lang, "gram": keys, "n": n})
                        held, size = [], 0
                if held:
                    keys, n = _counted(np.concatenate([_grams(x) for x in held]))
                    yield pd.DataFrame({"lang": lang, "gram": keys, "n": n})

    counts = (
        docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        .mapInPandas(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    order = (F.desc("n"), F.asc("gram"))
    # in two steps, so that a language's n-grams aren't ranked in one task
    part = counts.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(32)))
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("r") <= length)
    best = part.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= length)
    profiles: dict[str, list] = {}
    for row in best.select("lang", "gram", "r").collect():  # languages x length rows
        profiles.setdefault(row.lang, []).append((row.r, row.gram))
    return {lang: np.array([g for _, g in sorted(grams)], np.int64) for lang, grams in sorted(profiles.items())}


def predicted_language(text: Column, profiles: dict[str, np.ndarray], length: int) -> Column:
    """struct<lang string, score double> of a text."""
    names = list(profiles)
    keys = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.int64)]))
    # by n-gram and language: its rank, or -1
    ranks = np.full((len(keys), len(names)), -1, np.int64)
    for j, p in enumerate(profiles.values()):
        ranks[np.searchsorted(keys, p), j] = np.arange(len(p))

    def one(t: str | None) -> tuple[str, float]:
        if t is None or not names:
            return UNKNOWN, 0.0
        x = _runs(t)
        if len(x) < 3:
            return UNKNOWN, 0.0
        grams, n = _counted(_grams(x))
        own = grams[np.argsort(-n, kind="stable")[:length]]
        at = np.searchsorted(keys, own)
        at[at == len(keys)] = 0
        known = keys[at] == own
        rank = ranks[at[known]]
        off = np.where(rank >= 0, np.abs(rank - np.flatnonzero(known)[:, None]), length)
        distance = off.sum(axis=0) + length * int((~known).sum())
        best = int(np.argmin(distance))
        if len(names) == 1:
            return names[0], 1.0
        second = np.partition(distance, 1)[1]
        return names[best], float((second - distance[best]) / second) if second else 0.0

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=["lang", "score"])

    return predict(text)


def identify_languages(
    docs: DataFrame, train: Column, length: int = 300, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(id, lang_pred, score) of every row, learned from the rows where `train` holds."""
    profiles = learn_profiles(docs.where(train), length, text_col, lang_col)
    return docs.select(F.col(id_col), predicted_language(F.col(text_col), profiles, length).alias("_p")).select(
        id_col, F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score")
    )
