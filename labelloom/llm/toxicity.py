"""Toxicity from a learned lexicon, misspellings included.

The lexicon is learned from labelled training rows: words, and word stems of
four to six letters, that occur in toxic rows far more often than chance
allows. It is kept as a trie. For terms of five letters or more the trie is
walked together with a Levenshtein automaton of one edit, so that a misspelled
word reaches the term, or begins with the stem, it was made from; forms that
clean training rows contain don't count as misspellings. Every hit gets a score from the words and
quotation marks in the window around it, which tells quoted from direct use as
far as the labels show a difference. Few numbers for each document (hits by
kind, their window scores, its length) then go into a logistic regression.

All learning is from a bounded sample of the labelled rows where `train`
holds. Null and empty texts have no hits and get the score of a text without
hits. With labels of one kind only, every score is that kind's share.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import labelled_rows, labelled_sample

WINDOW = 5
STEMS = (4, 5, 6)
FUZZY_LETTERS = 5
CACHED_WORDS = 400_000
QUOTES = "\"'«»“”„‘’"
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
NONE, EXACT, FUZZY, STEM, NEAR_STEM = range(5)


class Trie:
    """Terms and stems; `match` says how a word reaches one of them."""

    def __init__(self, words: list[str], stems: list[str], clean_forms: frozenset[str] = frozenset()):
        self.next: list[dict[str, int]] = [{}]
        self.word, self.stem, self.fuzzy = [False], [False], [False]
        self.clean = clean_forms
        for term, is_stem in [(w, False) for w in words] + [(s, True) for s in stems]:
            at = 0
            for c in term:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    for x in (self.word, self.stem, self.fuzzy):
                        x.append(False)
                at = self.next[at][c]
            (self.stem if is_stem else self.word)[at] = True
            self.fuzzy[at] |= not is_stem and len(term) >= FUZZY_LETTERS
        lengths = [len(w) for w in words if len(w) >= FUZZY_LETTERS]
        self.fuzzy_lengths = (min(lengths, default=0) - 1, max(lengths, default=-2) + 1)
        # one edit leaves a term's first two letters or all after them as they are, so one of these is in place
        self.heads = frozenset(w[:2] for w in words if len(w) >= FUZZY_LETTERS)
        self.tails = frozenset(w[-3:] for w in words if len(w) >= FUZZY_LETTERS)
        # the same for the beginning of a word and a stem, whose tail may have moved by a letter
        self.fuzzy_stem = [s and d >= FUZZY_LETTERS for s, d in zip(self.stem, self._depths(), strict=True)]
        long_stems = [s for s in stems if len(s) >= FUZZY_LETTERS]
        self.stem_heads = frozenset(s[:2] for s in long_stems)
        self.stem_tails = frozenset(s[-3:] for s in long_stems)
        self.stem_starts = range(min(map(len, long_stems), default=9) - 4, max(map(len, long_stems), default=0) - 1)

    def _depths(self) -> list[int]:
        depths = [0] * len(self.next)
        for at, children in enumerate(self.next):  # children come after their parent
            for child in children.values():
                depths[child] = depths[at] + 1
        return depths

    def _near_stem(self, word: str) -> bool:
        return word[:2] in self.stem_heads or not self.stem_tails.isdisjoint([word[i : i + 3] for i in self.stem_starts])

    def match(self, word: str) -> int:
        at = 0
        for c in word:
            at = self.next[at].get(c, -1)
            if at < 0:
                break
            if self.stem[at]:
                return STEM
        else:
            if self.word[at]:
                return EXACT
        whole = self.fuzzy_lengths[0] <= len(word) <= self.fuzzy_lengths[1] and (word[:2] in self.heads or word[-3:] in self.tails)
        if (whole or (len(word) >= FUZZY_LETTERS and self._near_stem(word))) and word not in self.clean:
            return self.within_one_edit(word)
        return NONE

    def within_one_edit(self, word: str) -> int:
        """Trie and automaton in step, an edit tried after each letter that fits. A stem needs only the word's beginning."""
        at, near, end = 0, False, len(word)
        for i in range(end + 1):
            c = word[i : i + 1]
            edits = [(at, i + 1)] if c else []  # a letter too many
            for d, child in self.next[at].items():
                if c and d != c:
                    edits.append((child, i + 1))  # another letter
                    near = near or self.fuzzy_stem[child]
                if not c or c in self.next[child]:
                    edits.append((child, i))  # a letter too few
            for node, j in edits:
                while j < end and (node := self.next[node].get(word[j], -1)) >= 0:
                    near = near or self.fuzzy_stem[node]
                    j += 1
                if node >= 0 and self.fuzzy[node]:
                    return FUZZY
            if (at := self.next[at].get(c, -1)) < 0:
                break
            near = near or self.fuzzy_stem[at]
            if i == end - 1 and self.fuzzy[at]:
                return FUZZY
        return NEAR_STEM if near else NONE


class _Matches(dict):
    """Kinds by token."""

    def __init__(self, trie: Trie):
        super().__init__()
        self.trie = trie

    def __missing__(self, token: str) -> int:
        self[token] = kind = self.trie.match(normal(token))
        return kind

    def bound(self) -> None:
        if len(self) > CACHED_WORDS:
            self.clear()


def normal(token: str) -> str:
    return _EDGE.sub("", token.lower())


def window_features(tokens: list[str], at: int) -> list[str]:
    """Words around a hit, and whether quotation marks open before it and close after it."""
    before, after = tokens[max(0, at - WINDOW) : at], tokens[at + 1 : at + 1 + WINDOW]
    quoted = any(t[0] in QUOTES for t in [*before, tokens[at]]) and any(t.rstrip(".,;:!?")[-1:] in tuple(QUOTES) for t in [tokens[at], *after])
    return ["quoted" if quoted else "unquoted", *{f"w:{normal(t)}" for t in (*before, *after)}]


class Scorer:
    """Numbers of a document from its hits."""

    def __init__(self, trie: Trie, context: dict[str, float]):
        self.matches, self.context = _Matches(trie), context

    def hits(self, text: str) -> tuple[list[str], list[tuple[int, int]]]:
        tokens = text.split()
        self.matches.bound()
        kinds = list(map(self.matches.__getitem__, tokens))
        return tokens, [(i, k) for i, k in enumerate(kinds) if k] if any(kinds) else []

    def features(self, text: str | None) -> tuple[float, ...]:
        tokens, hits = self.hits(text or "")
        n = [0] * 5
        around = []
        for at, kind in hits:
            n[kind] += 1
            found = [self.context[f] for f in window_features(tokens, at) if f in self.context]
            around.append(max(-3.0, min(3.0, sum(found))))
        return (
            math.log1p(n[EXACT]), math.log1p(n[FUZZY]), math.log1p(n[STEM]), math.log1p(n[NEAR_STEM]), float(bool(n[EXACT] or n[STEM])),
            sum(around) / len(around) if around else 0.0, max(around, default=0.0), math.log1p(100 * len(hits) / (len(tokens) + 20)),
        )


def _term_counts(rows: DataFrame) -> DataFrame:
    """(term, kind, toxic, clean): rows of either label that hold a word or stem."""

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[tuple[str, int], list[int]] = {}
            for label, text in zip(batch["label"], batch["text"], strict=True):
                words = {w for t in set(text.split()) if len(w := normal(t)) >= 3}
                found = {(w, 0) for w in words} | {(w[:k], 1) for w in words for k in STEMS if len(w) > k}
                for f in found:
                    counts.setdefault(f, [0, 0])[1 - int(label > 0)] += 1
            yield pd.DataFrame([(w, k, t, c) for (w, k), (t, c) in counts.items()], columns=["term", "kind", "toxic", "clean"])

    return (
        rows.mapInPandas(terms, "term string, kind int, toxic long, clean long")
        .groupBy("term", "kind")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )


def learn_lexicon(rows: DataFrame, toxic: int, clean: int, chance: float = 0.01) -> tuple[list[str], list[str]]:
    """Words and stems whose share of toxic rows can't be chance, all terms taken together."""
    base = toxic / (toxic + clean)
    least = max(3, math.ceil(math.log(1e-4) / math.log(base)) if base < 1 else 3)
    # by the rule that a quarter of a term's rows at most are clean, few terms are left to collect
    counts = _term_counts(rows)
    frequent = counts.where(F.col("toxic") + F.col("clean") >= least).cache()
    tested = frequent.count()
    likely = frequent.where((F.col("toxic") >= least) & (F.col("clean") * 3 <= F.col("toxic"))).collect()
    frequent.unpersist()

    def tail(t: int, n: int) -> float:
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(base) + (n - i) * math.log1p(-base)) for i in range(t, n + 1))

    sure = [r for r in likely if tail(r.toxic, r.toxic + r.clean) * max(1, tested) < chance]
    words = {r.term: r.toxic for r in sure if r.kind == 0}
    stems: list[str] = []
    for r in sorted((r for r in sure if r.kind == 1), key=lambda r: (len(r.term), r.term)):
        # a stem stands for several words; one that a single word makes up is left to that word
        alone = max((n for w, n in words.items() if w.startswith(r.term)), default=0)
        if alone < 0.8 * r.toxic and not any(r.term.startswith(s) for s in stems):
            stems.append(r.term)
    return sorted(w for w in words if not any(w.startswith(s) for s in stems)), stems


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(
    docs: DataFrame, labels: DataFrame, train: Column, labelled: int = 20_000,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> DataFrame:
    """(id, score, predicted) of every row. `train` is a condition on doc_id; `labelled` bounds the sample."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = labelled_sample(labels.withColumnRenamed(id_col, "doc_id").where(train), label_col, labelled)
    fold = F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(2)).cast("int")
    rows = labelled_rows(texts, marked, labelled, "text").select("label", "text", fold.alias("fold")).persist()
    sizes = {int(r.label > 0): r["count"] for r in rows.groupBy((F.col("label") > 0).cast("int").alias("label")).count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        rows.unpersist()
        share = F.lit(1.0 if toxic else 0.0)
        return texts.select(F.col("doc_id").alias(id_col), share.alias("score"), (share >= 0.5).cast("int").alias("predicted"))
    words, stems = learn_lexicon(rows, toxic, clean)
    trie = Trie(words, stems)

    def clean_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matches = _Matches(trie)
        for batch in batches:
            found = set()
            for text, fold in zip(batch["text"], batch["fold"], strict=True):
                matches.bound()
                found |= {(normal(t), fold) for t in set(text.split()) if matches[t] in (FUZZY, NEAR_STEM)}
            yield pd.DataFrame(sorted(found), columns=["form", "fold"])

    forms = rows.where("label = 0").select("text", "fold").mapInPandas(clean_forms, "form string, fold int").distinct().collect()
    trie = Trie(words, stems, frozenset(r.form for r in forms))  # of one edit around the lexicon
    # rows to learn weights from meet the clean forms of the other half, as new rows will
    crossed = [Trie(words, stems, frozenset(r.form for r in forms if r.fold != f)) for f in (0, 1)]

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(trie, {})
        for batch in batches:
            out = []
            for label, text in zip(batch["label"], batch["text"], strict=True):
                tokens, hits = scorer.hits(text)
                out += [(f, int(label > 0), int(label <= 0)) for at, _ in hits for f in window_features(tokens, at)]
            yield pd.DataFrame(out, columns=["feature", "toxic", "clean"])

    seen = rows.mapInPandas(windows, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    counted = seen.where("t + c >= 20 or feature in ('quoted', 'unquoted')").collect()
    a, b = sum(r.t for r in counted) + 1, sum(r.c for r in counted) + 1
    context = {r.feature: math.log((r.t + 20 * (r.t + r.c) / (a + b)) / (a + 20)) - math.log((r.c + 20 * (r.t + r.c) / (a + b)) / (b + 20)) for r in counted}

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = [Scorer(t, context) for t in crossed]
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "x": [scorers[f].features(t) for t, f in zip(batch["text"], batch["fold"], strict=True)]})

    known = rows.mapInPandas(numbers, "label int, x array<double>").toPandas()
    rows.unpersist()
    weights = fit_logistic(np.array(known["x"].tolist()), (known["label"].to_numpy() > 0).astype(float))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(trie, context)
        for batch in batches:
            x = np.array([scorer.features(t) for t in batch]).reshape(len(batch), -1)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))))

    return texts.select(F.col("doc_id").alias(id_col), score("text").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
