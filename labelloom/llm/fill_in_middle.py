"""Fill-in-middle: parts of a text moved so that a model learns to fill the gap.

A text's units are runs of ASCII letters and single other characters. Two of
the n + 1 places between them, drawn by a hash of the id, cut it into prefix,
middle and suffix, which are written in one of two orders behind marks. Texts
without characters, texts that hold a mark and a share of all others stay as
they are.

Units are not listed. One Aho-Corasick automaton runs over the text once, with
two-character words for every ASCII character that is a letter and follows
none, or is none and follows one, and with the marks. Characters beyond ASCII
are no letters and stand as ? in what it reads, one for one. Its matches are
the only events: between two of them lies one run of letters, which is one
unit, or characters that are units each, so the number of units before every
event is a running sum, and the place of any rank is found by bisection and
subtraction.

A null text is empty; empty texts are plain. A null id draws as the empty
string does. Repeated rows get equal results, as nothing but id and text
counts; an empty table gives no rows; other columns don't matter. A text is
held whole, with two numbers for each event.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from string import ascii_letters

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Hundredths of texts that stay plain, and of the others that begin with the suffix.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
MARK = -1


@lru_cache(maxsize=1)
def events_automaton() -> ahocorasick.Automaton:
    """Finds where ASCII characters change between letters and others, and the marks."""
    found = ahocorasick.Automaton()
    others = [c for c in map(chr, range(128)) if c not in ascii_letters]
    for a in ascii_letters:
        for b in others:
            found.add_word(a + b, 0)
            found.add_word(b + a, 0)
    for mark in MARKS:
        found.add_word(mark, MARK)
    found.make_automaton()
    return found


def scanned(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """Where runs of either class begin and the text ends, the units before each of these places, and whether a mark occurs."""
    if not text:
        return np.zeros(1, np.int64), np.zeros(1, np.int64), False
    flat = text.encode("ascii", "replace").decode("ascii")
    starts, marked = [0], False
    for at, kind in events_automaton().iter(flat):
        if kind == MARK:
            marked = True
        else:
            starts.append(at)
    starts.append(len(flat))
    places = np.array(starts, np.int64)
    units = np.diff(places)
    units[(0 if flat[0].isalpha() else 1) :: 2] = 1
    return places, np.concatenate([[0], np.cumsum(units)]), marked


def place_of(rank: int, places: np.ndarray, ranks: np.ndarray) -> int:
    """The character before which `rank` units lie."""
    k = int(np.searchsorted(ranks, rank, "right")) - 1
    return int(places[k] + rank - ranks[k])


def transformed(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple[int, str, int | None, int | None, str]:
    places, ranks, marked = scanned(text)
    n = int(ranks[-1])
    if not text or marked or h3 % 100 >= PLAIN_FROM:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = place_of(a, places, ranks), place_of(b, places, ranks)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", i, j - i, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", i, j - i, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def moved(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, *hashes in batches:
            rows = [transformed(t or "", *h) for t, *h in zip(texts, *(h.tolist() for h in hashes), strict=True)]
            made = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield made.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col), moved(text, *draws).alias("_m")).select(id_col, "_m.*")


def restored_text(output: Column, form: Column) -> Column:
    """The text before it was moved. Its parts hold no mark, so the first mark of each kind is ours."""

    def between(first: str, second: str) -> Column:
        """What stands before, between and behind the two marks that follow the leading one."""
        at = F.locate(first, output)
        then = F.locate(second, output, 1) - at - len(first)
        part = F.substring(output, 1 + len(MARKS[0]), at - 1 - len(MARKS[0]))
        rest = F.substring(output, at + len(first), F.length(output))
        return F.struct(part.alias("a"), F.substring(rest, F.lit(1), then).alias("b"), F.substring(rest, then + 1 + len(second), F.length(output)).alias("c"))

    psm, spm = between(SUFFIX, MIDDLE), between(PREFIX, MIDDLE)
    return F.when(form == "psm", F.concat(psm["a"], psm["c"], psm["b"])).when(form == "spm", F.concat(spm["b"], spm["c"], spm["a"])).otherwise(output)


def oracle(seed: int = 1) -> str:
    """The same rows in SQL, from lists of units; the text restored is the text."""
    hashed = ", ".join(f"CAST('0x' || substr(sha256('{seed}:' || doc_id), {1 + 8 * k}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, {hashed} FROM documents),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM d),
p AS (
  SELECT doc_id, n, t, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""
