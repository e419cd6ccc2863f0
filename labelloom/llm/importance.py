"""Quality classification by importance resampling.

Two generative models of hashed n-grams are fitted: one to target text (rows
labelled good), one to the raw text (every row). A document's importance is
the ratio of its likelihoods under the two; rows are drawn without replacement
in proportion to it, as the top k of log importance plus Gumbel noise.

The n-grams (one and two) run over word forms: what kinds of characters
a word is made of, and whether it repeats the word before it or one of the few
before that. Forms, unlike words, are shared by all languages and topics, so
the target doesn't have to hold every language in the right proportion. The
log ratio is that of a draw of `span` n-grams from the document, so that long
and short documents compare alike. `span` is an inverse temperature: the noise
has a standard deviation of 1.3, so that of two documents whose mean log ratios
differ by much more than 1.3 / span the better one is drawn for sure, and among
closer ones the draw is by chance in proportion to their importance. At 5 rows
near the cut change places; clean text lies far above it.

k is the number of rows whose ratio passes a cut that labelled rows set; with
no labels of both kinds, all rows are kept. The target comes from a bounded
sample of labelled rows, the raw model from all rows. Texts that are null or
have no word carry no n-gram; they score 0, as the raw text does on average.
Ties at the k-th key are kept together. Repeated rows score alike but draw
their noise from the id and text, so equal rows share one fate.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import labelled_rows, labelled_sample, stage
from labelloom.llm.quality_rules import calibrated

BUCKETS = 10_000
CACHED_FORMS = 100_000
NEAR = 10
_KINDS = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 46 if c in b".,;:" else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


class _Forms(dict):
    """By word: a number for the kinds of characters in it, runs as one."""

    def __missing__(self, word: bytes) -> int:
        import zlib

        form = _RUN.sub(rb"\1", word.translate(_KINDS))
        self[word] = out = zlib.crc32(form) & 0xFFFFF
        return out


_forms = _Forms()


def buckets_of(text: bytes) -> np.ndarray:
    """The hash buckets of a text's n-grams, one entry for each occurrence."""
    words = text.split()
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    if len(_forms) > CACHED_FORMS:
        _forms.clear()
    form = np.fromiter(map(_forms.__getitem__, words), np.int64, n)
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    order = np.argsort(code, kind="stable")
    gap = np.full(n, n + 1, np.int64)
    same = code[order][1:] == code[order][:-1]
    gap[order[1:][same]] = (order[1:] - order[:-1])[same]
    item = form * 3 + np.where(gap == 1, 2, np.where(gap <= NEAR, 1, 0))
    one = (item * 0x9E3779B1) & 0x7FFFFFFF
    two = ((item[:-1] * 0x85EBCA6B) ^ (item[1:] * 0xC2B2AE35)) & 0x7FFFFFFF
    return np.concatenate([one % BUCKETS, two % BUCKETS])


def bucket_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each bucket occurs in all rows: one row a bucket and task goes into the sum."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t in batch["text"]:
                total += np.bincount(buckets_of(t.encode()), minlength=BUCKETS)
        at = np.flatnonzero(total)
        _forms.clear()  # workers outlive their task
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    rows = (
        docs.where(F.col(text_col).isNotNull())
        .select(F.col(text_col).alias("text"))
        .mapInPandas(count, "bucket long, n long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .collect()  # BUCKETS rows at most
    )
    out = np.zeros(BUCKETS)
    for r in rows:
        out[r.bucket] = r.n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """By bucket: log of the two smoothed models' ratio."""
    shared = (raw + 1) / (raw.sum() + len(raw))
    model = (target + 100 * shared) / (target.sum() + 100)
    return np.log(model) - np.log(shared)


def importance(text: Column, ratio: np.ndarray, span: int) -> Column:
    """Log importance of `span` n-grams drawn from the text."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.zeros(len(texts))
            for i, t in enumerate(texts):
                if t is not None and len(b := buckets_of(t.encode())):
                    out[i] = span * ratio[b].mean()
            yield pd.Series(out)
        _forms.clear()

    return score(text)


def gumbel(*keys: Column) -> Column:
    """Standard Gumbel noise that is fixed by the keys."""
    u = (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, key: str, k: int) -> float:
    """A cut that at least k rows reach, and hardly more: to within 1/32768.

    Histograms of fixed size find it: first bins of 1/8 between -4096 and
    4096, then 4096 parts of the one bin that holds the k-th key.
    """
    if k <= 0:
        return math.inf
    coarse = F.floor(F.greatest(F.least(F.col(key), F.lit(4096.0)), F.lit(-4096.0)) * 8).cast("long")
    bins = df.groupBy(coarse.alias("b")).count().collect()
    left = k
    for b, n in sorted(((r.b, r["count"]) for r in bins), reverse=True):
        if n >= left:
            break
        left -= n
    else:
        return -math.inf
    if b in (-32768, 32768):
        return -math.inf if b < 0 else 4096.0
    fine = F.floor((F.col(key) * 8 - F.lit(b)) * 4096).cast("long")
    parts = df.where(coarse == b).groupBy(fine.alias("p")).count().collect()
    for p, n in sorted(((r.p, r["count"]) for r in parts), reverse=True):
        if n >= left:
            return (b + p / 4096) / 8
        left -= n
    return b / 8


@dataclass(frozen=True)
class Resampling:
    """A fitted draw: a row is kept if its key reaches the cut."""

    ratio: np.ndarray
    span: int
    seed: int
    cut: float

    def log_importance(self, text: Column) -> Column:
        return importance(text, self.ratio, self.span)

    def key(self, id_: Column, text: Column) -> Column:
        return self.log_importance(text) + gumbel(F.lit(self.seed), id_, F.xxhash64(text))

    def kept(self, id_: Column, text: Column) -> Column:
        return self.key(id_, text) >= self.cut


def fit_resampling(
    docs: DataFrame, labels: DataFrame, span: int = 5, labelled: int = 20_000, cost: float = 10.0,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 2,
) -> tuple[Resampling, DataFrame]:
    """The draw, and (doc_id, text_hash, log_importance, key) of every row.

    `labelled` labelled rows at most make the target model and set the cut.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = stage(labelled_sample(labels.withColumnRenamed(id_col, "doc_id"), label_col, labelled), "labelled")
    seen = labelled_rows(texts, marked, labelled, "text")
    ratio = log_ratio(bucket_counts(seen.where("label = 1")), bucket_counts(texts))
    draw = Resampling(ratio, span, seed, -math.inf)
    scored = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), draw.log_importance(F.col("text")).alias("log_importance"))
    scored = stage(scored.withColumn("key", F.col("log_importance") + gumbel(F.lit(seed), F.col("doc_id"), F.col("text_hash"))), "importance")
    known = labelled_rows(scored.select("doc_id", "text_hash", "log_importance"), marked, labelled, "text_hash").select("label", "log_importance").toPandas()
    cut = calibrated(-known["log_importance"].to_numpy(float), known["label"].to_numpy() == 0, cost) if len(known) else None
    if cut is None:
        return draw, scored
    k = scored.where(F.col("log_importance") > -cut).count()
    return replace(draw, cut=kth_largest(scored, "key", k)), scored


def resample_by_importance(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **parameters) -> DataFrame:
    """(id, text_hash, log_importance, key, kept) of every row."""
    draw, scored = fit_resampling(docs, labels, id_col=id_col, **parameters)
    return scored.withColumn("kept", F.col("key") >= draw.cut).withColumnRenamed("doc_id", id_col)
