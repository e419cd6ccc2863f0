"""Token counts by overlap resynchronisation.

A document longer than `chunk` characters is encoded in overlapping chunks,
with offsets. The pre-tokeniser is a left-to-right scan whose state at the
start of a piece is nothing but the text to its right, hence: where the same
character is the start of a piece in both chunks, and the left chunk's pieces
up to it end clear of that chunk's cut end, the whole text has a piece start
there too, and the right chunk agrees with the whole text from there on. The
counts are spliced at the last such boundary. Where an overlap holds none, it
is doubled; it ends at the previous splice at the latest, which is a boundary.

Shorter documents need no splicing. For byte-level vocabularies their pieces
are looked up in a bounded table of counts that the library made, for every
unit is then encoded once and not at each occurrence: a unit is a run of white
space or a word with the space before it, across which no piece reaches.

Nulls count as empty: 0 bytes, 0 tokens. Repeated rows are counted each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Pieces of the byte-level pattern never reach across these units.
UNIT = re.compile(r" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+(?![^\x20\x09-\x0D])|[\x20\x09-\x0D]+")
#: White space to the library but not in UNIT; such texts take the long way.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
CACHED_UNITS = 600_000


class _UnitCounts(dict):
    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, unit: str) -> int:
        n = len(self.tokenizer.encode(unit, add_special_tokens=False).ids)
        self[unit] = n
        return n


class Counter:
    """Counts tokens of one text at a time, in bounded memory beside the text."""

    def __init__(self, path: str, chunk: int, overlap: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunk, self.overlap = chunk, overlap
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        config = json.loads(self.tokenizer.to_str())
        self.specials = [t["content"] for t in config.get("added_tokens", [])]
        self.guard = max([8, *(len(s) + 2 for s in self.specials)])
        pre = config.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.units = _UnitCounts(self.tokenizer) if plain and not config.get("normalizer") else None
        self.widened = 0

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if len(text) > self.chunk:
            return self.spliced(text)
        if self.units is None or ODD_SPACE.search(text) or any(s in text for s in self.specials):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self.units) > CACHED_UNITS:
            self.units.clear()
        return sum(map(self.units.__getitem__, UNIT.findall(text)))

    def _starts(self, text: str, begin: int, end: int) -> tuple[dict[int, int], int]:
        """Character positions at which pieces start, each with the number of tokens before it."""
        e = self.tokenizer.encode(text[begin:end], add_special_tokens=False)
        found, last = {}, object()
        for i, (word, (at, _)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
            if word != last or word is None:
                found.setdefault(begin + at, i)
                last = word
        return found, len(e.ids)

    def spliced(self, text: str) -> int:
        total, splice, begin = 0, 0, 0
        end = min(len(text), self.chunk)
        starts, n = self._starts(text, begin, end)
        while end < len(text):
            stable = sorted(p for p in starts if p > splice and p < end - self.guard)
            # the piece that starts last may still grow beyond the cut
            stable = stable[:-1]
            width = self.overlap
            while True:
                floor = splice if width >= end - splice else end - width
                # each chunk adds as much as it repeats, at least, so the work stays linear
                next_end = min(len(text), max(2 * end - floor, floor + self.chunk))
                right, right_n = self._starts(text, floor, next_end)
                at = next((p for p in reversed(stable) if p in right and (p > floor or floor == splice)), None)
                if at is None and floor == splice:
                    at = splice
                if at is not None:
                    break
                width *= 2  # no common boundary: widen the overlap
                self.widened += 1
            if at == splice and next_end == end:
                raise AssertionError("no progress")
            total += starts[at] - starts.get(splice, 0)
            splice, starts, n, end = at, right, right_n, next_end
        return total + n - starts.get(splice, 0)


_counters: dict[tuple, Counter] = {}


def _counter(path: str, chunk: int, overlap: int) -> Counter:
    key = (path, chunk, overlap)
    if key not in _counters:
        _counters[key] = Counter(*key)
    return _counters[key]


def token_count(text: Column, tokenizer_path: str, chunk: int = 32_768, overlap: int = 256) -> Column:
    """The number of tokens that the library gives for a text, begin, end and added special tokens left out."""

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(tokenizer_path, chunk, overlap)
        for texts in batches:
            yield pd.Series([counter(t) for t in texts], dtype="int64")

    return count(text)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; other columns are not read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col), text.alias("_text"))
        .select(
            F.col(id_col),
            F.octet_length("_text").cast("long").alias("n_bytes"),
            token_count(F.col("_text"), tokenizer_path).alias("n_tokens"),
        )
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
