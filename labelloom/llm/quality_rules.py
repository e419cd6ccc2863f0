"""Quality rules with an isolation forest over their statistics.

Each text gets counts that simple rules look at. An isolation forest is grown
over how far rates made of them go beyond the limits of common rules: in each tree random splits part the rows
until rows stand alone, and a row that stands alone after few splits is an
anomaly. Anomalies with a score over a threshold are rejected; labelled rows
set the threshold, so that few good rows are lost.

Every tree is grown over all rows, level by level: Spark finds how far the
rates reach in each open node and how many rows it holds, and the driver draws
the splits. Only the height of a tree is bounded, and with it the model; a
caller may ask for the classic draw of so many rows a tree instead. All
labelled rows set the threshold. Null and empty texts have no words and fail
the base rule. Repeated rows get equal results. Without labels of both kinds
no row but those that fail the base rule is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import hash_sample, stage

SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_letters")
RATES = ("symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "mark_rate", "word_length")
_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    size = len(ids)
    if size < 2_000_000:
        key = (code[:-2] * size + code[1:-1]) * size + code[2:]
    else:  # keys of pairs first, as three codes don't fit 63 bits
        _, pair = np.unique(code[:-1] * size + code[1:], return_inverse=True)
        key = pair[:-1] * size + code[2:]
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    again = n[back] > 1
    hit = np.zeros(len(words), bool)
    for shift in range(3):
        hit[shift : shift + len(again)] |= again
    return int(hit.sum())


def statistics_of(text: bytes) -> tuple[int, ...]:
    words = text.split()  # of bytes: at ASCII white space
    flat = text.translate(_SPACE)
    wide = 0 if text.isascii() else int((np.frombuffer(text, np.uint8) & 0xC0 == 0x80).sum())
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    b = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    return (
        len(words),
        len(text) - wide - flat.count(b" "),
        int(b[list(SYMBOLS)].sum()),
        dup,
        repeated_words(words),
        lines,
        int(b[65:91].sum()),
        int(b[[33, 63]].sum()),
        int(b[65:91].sum() + b[97:123].sum() + b[0xC2:0xF5].sum()),
    )


def rule_statistics(text: Column) -> Column:
    """struct of STATS, all long."""

    @F.pandas_udf(", ".join(f"{s} long" for s in STATS))
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([statistics_of((t or "").encode()) for t in texts], columns=list(STATS))

    return stats(text)


#: What a rule lets pass; statistics are how far a text goes beyond.
LIMITS = {"symbol_rate": 0.1, "dup_line_rate": 0.3, "repeat_rate": 0.2, "upper_rate": 0.3, "mark_rate": 0.1}
WORD_LENGTHS = (3.0, 10.0)


def _rates() -> list[Column]:
    def over(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    def beyond(rate: Column, name: str) -> Column:
        return F.greatest(rate - LIMITS[name], F.lit(0.0)).alias(name)

    length = over("word_chars", "n_words")
    return [
        beyond(over("n_symbols", "n_words"), "symbol_rate"),
        beyond(over("n_dup_lines", "n_lines"), "dup_line_rate"),
        beyond(over("n_repeat_words", "n_words"), "repeat_rate"),
        beyond(over("n_upper", "n_letters"), "upper_rate"),
        beyond(over("n_marks", "n_words"), "mark_rate"),
        F.greatest(length - WORD_LENGTHS[1], F.lit(WORD_LENGTHS[0]) - length, F.lit(0.0)).alias("word_length"),
    ]


def grow_forest(rows: np.ndarray, trees: int, sample: int, seed: int) -> list[tuple[np.ndarray, ...]]:
    """Trees as arrays: feature (-1: leaf), cut, left, right, path length at a leaf."""
    rng = np.random.default_rng(seed)
    size = min(sample, len(rows))
    limit = max(1, int(np.ceil(np.log2(max(2, size)))))
    forest = []
    for _ in range(trees):
        feature, cut, left, right, length = [], [], [], [], []

        def node(part: np.ndarray, depth: int) -> int:
            at = len(feature)
            for x in (feature, left, right):
                x.append(-1)
            cut.append(0.0)
            length.append(depth + expected_path(len(part)))
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 else []
            if depth < limit and len(spread):  # noqa: B023
                f = int(rng.choice(spread))
                c = float(rng.uniform(part[:, f].min(), part[:, f].max()))
                low = part[:, f] <= c
                feature[at], cut[at] = f, c
                left[at] = node(part[low], depth + 1)
                right[at] = node(part[~low], depth + 1)
            return at

        node(rows[rng.choice(len(rows), size, replace=False)], 0)
        forest.append(tuple(map(np.array, (feature, cut, left, right, length))))
    return forest


def expected_path(n: int) -> float:
    """Mean length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def leaves(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """The node without a split that each row comes to."""
    feature, cut, left, right, _ = tree
    at = np.zeros(len(x), np.int64)
    open_ = np.arange(len(x))
    while len(open_ := open_[feature[at[open_]] >= 0]):
        a = at[open_]
        at[open_] = np.where(x[open_, feature[a]] <= cut[a], left[a], right[a])
    return at


def node_ranges(rows: DataFrame, forest: list[tuple[np.ndarray, ...]], depth: int) -> DataFrame:
    """(tree, node, n, low_i, high_i) of the nodes at this depth: their rows and how far each rate reaches, from rows (RATES, n)."""
    first, width = 2**depth - 1, 2**depth
    lows, highs = ([f"{end}_{i}" for i in range(len(RATES))] for end in ("low", "high"))

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((len(forest), width), np.int64)
        low = np.full((len(forest), width, len(RATES)), np.inf)
        high = np.full((len(forest), width, len(RATES)), -np.inf)
        for batch in batches:
            x, count = batch[list(RATES)].to_numpy(float), batch["n"].to_numpy()
            for t, tree in enumerate(forest):
                at = leaves(x, tree) - first  # leaves of lesser depth come before
                order = np.argsort(at, kind="stable")
                order = order[np.searchsorted(at[order], 0) :]
                if len(order):
                    node, start = np.unique(at[order], return_index=True)
                    n[t, node] += np.add.reduceat(count[order], start)
                    low[t, node] = np.minimum(low[t, node], np.minimum.reduceat(x[order], start, axis=0))
                    high[t, node] = np.maximum(high[t, node], np.maximum.reduceat(x[order], start, axis=0))
        tree, node = np.nonzero(n)
        told = {"tree": tree, "node": first + node, "n": n[tree, node]}
        ends = {c: part[tree, node, i] for columns, part in ((lows, low), (highs, high)) for i, c in enumerate(columns)}
        yield pd.DataFrame(told | ends)

    schema = "tree long, node long, n long, " + ", ".join(f"{c} double" for c in lows + highs)
    found = rows.mapInPandas(ranges, schema).groupBy("tree", "node")
    return found.agg(F.sum("n").alias("n"), *(F.min(c).alias(c) for c in lows), *(F.max(c).alias(c) for c in highs))


def grow_over_all(rows: DataFrame, trees: int, height: int, seed: int) -> tuple[list[tuple[np.ndarray, ...]], int]:
    """The forest grown over all of (RATES, n), n rows each, and the number of rows.

    Nodes are numbered as in a heap. What comes to the driver is a line a node,
    `trees` x 2^`height` at most. Splits depend on seed, tree, node and reach
    alone, not on how rows are dealt.
    """
    size = 2 ** (height + 1) - 1
    feature, cut, length = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    left = 2 * np.arange(size) + 1
    forest = [(feature[t], cut[t], left, left + 1, length[t]) for t in range(trees)]
    total = 0
    for depth in range(height + 1):
        found = node_ranges(rows, forest, depth).toPandas().to_numpy(float)
        for line in found:
            t, node, n = map(int, line[:3])
            low, high = line[3 : 3 + len(RATES)], line[3 + len(RATES) :]
            total = n if depth == 0 else total
            length[t, node] = depth + expected_path(n)
            spread = np.flatnonzero(high > low)
            if depth < height and len(spread):
                rng = np.random.default_rng((seed, t, node))
                f = int(rng.choice(spread))
                c = float(rng.uniform(low[f], high[f]))
                feature[t, node], cut[t, node] = f, c if c < high[f] else low[f]
        if not len(found):
            break
    return forest, total


def anomaly_scores(x: np.ndarray, forest: list[tuple[np.ndarray, ...]], sample: int) -> np.ndarray:
    """Between 0 and 1; rows of short paths come near 1."""
    total = np.zeros(len(x))
    for tree in forest:
        total += tree[-1][leaves(x, tree)]
    return 2.0 ** (-total / (len(forest) * max(expected_path(sample), 1.0)))


def calibrated(score: np.ndarray, bad: np.ndarray, cost: float) -> float | None:
    """The least score to reject: it loses few good rows, each `cost` times as dear as a bad one kept."""
    if not bad.any() or bad.all():
        return None
    order = np.argsort(-score, kind="stable")
    s, b = score[order], bad[order]
    gain = np.cumsum(b) / b.sum() - cost * np.cumsum(~b) / (~b).sum()
    last = np.concatenate([s[1:] != s[:-1], [True]])
    gain = np.where(last, gain, -np.inf)
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return None
    below = s[best + 1] if best + 1 < len(s) else s[best]
    return float((s[best] + below) / 2)


def calibrated_over(seen: DataFrame, cost: float, bins: int = 1 << 16) -> float | None:
    """`calibrated` over a table of any size, (anomaly, good, bad): rows of each kind with that score.

    Different scores are added up from the highest down: within a bin of scores, and over bins.
    """
    by_score = seen.groupBy("anomaly").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    by_score = stage(by_score.withColumn("bin", F.floor(F.col("anomaly") * bins)), "labelled-scores")
    goods, bads = by_score.agg(F.sum("good"), F.sum("bad")).first()
    if not goods or not bads:
        return None
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    totals = by_score.groupBy("bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    totals = totals.select("bin", *(F.coalesce(F.sum(k).over(above), F.lit(0)).alias(f"{k}_above") for k in ("good", "bad")))
    inside = Window.partitionBy("bin").orderBy(F.desc("anomaly")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lost, caught = (F.col(f"{k}_above") + F.sum(k).over(inside) for k in ("good", "bad"))
    gain = caught / F.lit(bads) - F.lit(float(cost)) * lost / F.lit(goods)
    best = by_score.join(F.broadcast(totals), "bin").select(gain.alias("gain"), "anomaly").agg(F.max(F.struct("gain", "anomaly")).alias("best")).first().best
    if best.gain <= 0:
        return None
    below = by_score.where(F.col("anomaly") < best.anomaly).agg(F.max("anomaly")).first()[0]
    return (best.anomaly + (best.anomaly if below is None else below)) / 2


def judge_quality(
    docs: DataFrame, labels: DataFrame, trees: int = 100, sample: int | None = None, height: int = 8,
    cost: float = 10.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 8,
) -> DataFrame:
    """(id, statistics, anomaly, base_failed, kept) of every row.

    All rows grow each of the `trees`, `height` splits deep at most; with
    `sample`, that many rows drawn for each tree do. All labelled rows set the
    threshold; `label_col` is 0 for bad rows.
    """
    table = stage(
        docs.select(F.col(id_col).alias("doc_id"), rule_statistics(F.col(text_col)).alias("_s"))
        .select("doc_id", "_s.*")
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .select("*", *_rates()),
        "rule-statistics",
    )
    rest = table.where(~F.col("base_failed"))
    if sample is None:
        forest, size = grow_over_all(stage(rest.groupBy(*RATES).agg(F.count("*").alias("n")), "rule-rates"), trees, height, seed)
    else:
        drawn = hash_sample(rest, trees * sample, "doc_id", *STATS, seed=seed).select(*RATES).toPandas()
        forest = grow_forest(drawn[list(RATES)].to_numpy(float), trees, sample, seed) if len(drawn) else []
        size = min(sample, max(2, len(drawn)))

    @F.pandas_udf("double")
    def anomaly(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            yield pd.Series(anomaly_scores(x, forest, size) if forest else np.zeros(len(x)))

    scored = stage(table.withColumn("anomaly", F.when(~F.col("base_failed"), anomaly(*RATES)).otherwise(F.lit(1.0))), "rule-anomalies")
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(label_col).alias("label"))
    # rows that share id and score are counted before the join
    seen = scored.where(~F.col("base_failed")).groupBy("doc_id", "anomaly").agg(F.count("*").alias("n")).join(marked, "doc_id")
    bad = F.when(F.col("label").cast("int") == 0, F.col("n")).otherwise(F.lit(0))
    cut = calibrated_over(seen.select("anomaly", (F.col("n") - bad).alias("good"), bad.alias("bad")), cost)
    kept = ~F.col("base_failed") & (F.col("anomaly") < cut if cut is not None else F.lit(True))
    return scored.withColumn("kept", kept).withColumnRenamed("doc_id", id_col)
