"""Sequence similarity, for which Spark has no function: Arrow batches through difflib.

Callers compare what needs no sequence matching with Column expressions, and
send null for it, or join texts on lengths and letters first and send what is
left, each different pair once.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from labelloom.functions import text as T
from labelloom.staging import dealt, stage_keyed


@lru_cache(maxsize=50_000)
def ratio(a: str, b: str) -> float:
    """Twice the matched characters over all; not symmetric. 0 where one is empty."""
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def at_least(a: str, b: str, least: float) -> float:
    """The ratio, or 0 where its bound by length, or by letters in common, is below `least`."""
    total = least * (len(a) + len(b))
    if not a or not b or 2 * min(len(a), len(b)) < total - 1e-9 or 2 * sum(min(a.count(c), b.count(c)) for c in set(a)) < total - 1e-9:
        return 0.0
    return ratio(a, b)


@F.pandas_udf(DoubleType())  # a type by name needs a session, and this runs at import
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """Ratio of the matching forms."""
    return sequence_ratio(T.match_form(a), T.match_form(b))


def reading_similarity(a: Column, b: Column) -> Column:
    """1 for equal letters and digits, from .75 on for containment, else the ratio."""
    x, y = T.unicode_alnum(a), T.unicode_alnum(b)
    none = (x == "") | (y == "")
    inside = x.contains(y) | y.contains(x)
    share = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))
    open_ = ~none & ~inside
    tail = sequence_ratio(F.when(open_, x), F.when(open_, y))
    return F.when(none, 0.0).when(x == y, 1.0).when(inside, 0.75 + 0.25 * share).otherwise(tail)


def fusion_similarity(a: Column, b: Column) -> Column:
    """1 for values equal in comparison form or in its letters and digits, else the ratio."""
    x, y = T.fusion_form(a), T.fusion_form(b)
    cx, cy = T.fusion_compact(a), T.fusion_compact(b)
    none = (x == "") | (y == "")
    same = (x == y) | ((cx != "") & (cx == cy))
    open_ = ~none & ~same
    return F.when(none, 0.0).when(same, 1.0).otherwise(sequence_ratio(F.when(open_, x), F.when(open_, y)))


def word_windows(words: Column, widths: list[int] | Column) -> Column:
    """All runs of so many neighbouring words, as structs (n, i, text): n words from the i-th on."""
    all_widths = widths if isinstance(widths, Column) else F.array(*map(F.lit, widths))

    def of(n: Column) -> Column:
        last = F.size(words) - n + 1
        runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(n.alias("n"), i.alias("i"), F.array_join(F.slice(words, i, n), " ").alias("text")))
        return F.when((n >= 1) & (last >= 1), runs).otherwise(F.array().cast("array<struct<n:int,i:int,text:string>>"))

    return F.flatten(F.transform(F.array_distinct(all_widths), of))


#: Letters that are counted each; all other characters are counted together.
_LETTERS = "abcdefghijklmnopqrstuvwxyz "


def letter_counts(text: Column) -> Column:
    counts = F.transform(F.array(*map(F.lit, _LETTERS)), lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))
    return F.concat(counts, F.array(F.length(text) - F.aggregate(counts, F.lit(0), lambda s, x: s + x)))


def ratio_bound(a: Column, b: Column, counts_a: Column, counts_b: Column) -> Column:
    """No ratio is above twice the characters that two texts have in common, in any order, over all."""
    common = reduce(lambda s, k: s + F.least(F.get(counts_a, F.lit(k)), F.get(counts_b, F.lit(k))), range(len(_LETTERS) + 1), F.lit(0))
    return 2 * common / (F.length(a) + F.length(b))


def label_lengths(spark: SparkSession, kinds: dict[str, list[str]], least: float) -> DataFrame:
    """(chars, n, kind, label, label_no): each label with the lengths in characters and words of the windows that may resemble it.

    Its size follows from the fixed labels: some dozens, by lengths and three widths.
    """
    labels = [(kind, label, no) for kind, labels in kinds.items() for no, label in enumerate(labels)]
    rows = [
        (chars, n, kind, label, no)
        for kind, label, no in labels
        for n in range(max(1, label.count(" ")), label.count(" ") + 3)
        for chars in range(1, int(len(label) * (2 / least - 1)) + 1)
        if 2 * min(chars, len(label)) >= least * (chars + len(label)) - 1e-9
    ]
    return spark.createDataFrame(rows, "chars int, n int, kind string, label string, label_no int")


def closest_labels(forms: DataFrame, kinds: dict[str, list[str]], least: float = 0.82) -> DataFrame:
    """(form, kind, label): of each kind the label that a run of about as many words of a form resembles most, by `least`; ties to the first label.

    A similarity join of the windows of different forms with the labels: by their
    lengths, then by a bound from their letters; ratios of what is left, each
    different pair once.
    """
    spark = forms.sparkSession
    labels = label_lengths(spark, kinds, least).withColumn("label_counts", letter_counts(F.col("label")))
    most = max(label.count(" ") + 2 for found in kinds.values() for label in found)
    runs = dealt(forms.select("form").where("form <> ''"), "form").distinct().select("form", F.inline(word_windows(F.split("form", " "), list(range(1, most + 1)))))
    # counted once a window, not once a pair
    runs = runs.select("form", "n", "text", F.length("text").alias("chars"), letter_counts(F.col("text")).alias("counts")).join(F.broadcast(labels), ["chars", "n"])
    bound = ratio_bound(F.col("text"), F.col("label"), F.col("counts"), F.col("label_counts"))
    pairs = stage_keyed(runs.where(bound >= least - 1e-9).select("form", "text", "kind", "label", "label_no").distinct(), "label-pairs")
    different = dealt(pairs.select("text", "label").distinct(), "text", "label")
    ratios = different.withColumn("ratio", sequence_ratio(F.col("text"), F.col("label"))).where(F.col("ratio") >= least)
    order = F.struct((-F.col("ratio")).alias("r"), "label_no")
    return pairs.join(ratios, ["text", "label"]).groupBy("form", "kind").agg(F.min_by("label", order).alias("label"))


def with_labels(lines: DataFrame, kinds: dict[str, list[str]], name: str = "label", least: float = 0.82) -> DataFrame:
    """Lines (with `form`) and a struct of the label of each kind: the first contained, else the closest, else null."""
    exact = F.struct(*(T.exact_label(F.col("form"), labels).alias(k) for k, labels in kinds.items()))
    close = closest_labels(lines.select("form"), kinds, least).groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("kind", "label"))).alias("_close"))
    told = lines.withColumn("_exact", exact).join(stage_keyed(close, "close-labels"), "form", "left")
    both = F.struct(*(F.coalesce(F.col(f"_exact.{k}"), F.col("_close")[k]).alias(k) for k in kinds))
    return told.select(*lines.columns, both.alias(name))


def without_damaged_label(pairs: DataFrame, least: float = 0.84) -> DataFrame:
    """(text, label, rest) of different (text, label): the text without the run of about as many words that resembles the label most.

    Where none does by `least` the text stays. Ties go to the narrower run, then to the earlier one.
    """
    pairs = dealt(pairs.select("text", "label"), "text", "label").distinct()
    words, width = F.split("text", " "), F.size(F.split("label", " "))
    runs = pairs.select(F.col("text").alias("whole"), "label", F.inline(word_windows(words, F.array(width - 1, width, width + 1))))
    runs = runs.withColumn("form", T.match_form(F.col("text")))
    ratios = stage_keyed(runs.select("form", "label").distinct().withColumn("ratio", sequence_ratio(F.col("form"), F.col("label"))).where(F.col("ratio") >= least), "damaged-labels")
    order = F.struct("ratio", (-F.col("n")).alias("n"), (-F.col("i")).alias("i"))
    best = runs.join(ratios, ["form", "label"]).groupBy("whole", "label").agg(F.max_by(F.struct("n", "i"), order).alias("b"))
    rest = F.concat(F.slice(words, F.lit(1), F.col("b.i") - 1), F.slice(words, F.col("b.i") + F.col("b.n"), F.size(words)))
    told = pairs.join(best.withColumnRenamed("whole", "text"), ["text", "label"], "left")
    return told.select("text", "label", F.when(F.col("b").isNull(), F.col("text")).otherwise(F.ltrim(F.array_join(rest, " "), F.lit(" :-;."))).alias("rest"))


def with_rests(lines: DataFrame, kinds: dict[str, list[str]], name: str = "rest") -> DataFrame:
    """Lines (with text, form and a struct `label`) and a struct of their text without the label of each kind; null where they bear none.

    A label that the form contains to the letter goes from the text; one that is
    damaged in the text goes with the words it is in; a text without any stays.
    """
    text = T.clean(F.col("text"))
    found = {k: F.when(F.col(f"label.{k}").isNotNull(), T.exact_label(F.col("form"), labels)) for k, labels in kinds.items()}
    literal = F.struct(*(F.when(F.col(f"label.{k}").isNotNull(), F.coalesce(T.without_exact_label(F.col("text"), labels), F.when(found[k].isNull(), text))).alias(k) for k, labels in kinds.items()))
    told = stage_keyed(lines.withColumn("_text", text).withColumn("_found", F.struct(*(c.alias(k) for k, c in found.items()))).withColumn("_rest", literal), "lines-and-rests")
    damaged = F.array(*(F.when(F.col(f"_rest.{k}").isNull(), F.col(f"_found.{k}")) for k in kinds))
    pairs = told.select(F.col("_text").alias("text"), F.explode(damaged).alias("label")).where("label is not null")
    rests = without_damaged_label(pairs).groupBy(F.col("text").alias("_text")).agg(F.map_from_entries(F.collect_list(F.struct("label", "rest"))).alias("_damaged"))
    both = F.struct(*(F.coalesce(F.col(f"_rest.{k}"), F.try_element_at(F.col("_damaged"), F.col(f"_found.{k}"))).alias(k) for k in kinds))
    return told.join(stage_keyed(rests, "rests"), "_text", "left").select(*lines.columns, both.alias(name))
