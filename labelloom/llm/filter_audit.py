"""How filters act on each other: what each removes, in every order of them.

Five filters look at each document. Which of them it fails is a number below
32, a bit for each filter; in a given order the first that it fails removes it.
A table of 32 by 120 holds, for every such number and every order of the five,
the step at which the document goes (0: it stays). Tasks look their rows up in
the table and count part, order and step in one array, plainly and by label;
the arrays of all tasks are summed. Everything reported follows from those
counts: what is left after a step, what a filter would have removed had it not
gone before (from orders that begin with it), what it alone removes (from
orders that end with it), and its Shapley value as a sum over all orders.

The copy filter knows no order of rows in one task: a text's smallest id is
found by aggregation, and a row is a copy if its id is larger. Rows equal in
text, id and part are counted together before anything is joined, so a text
that a third of all rows share is one key of the sum and none of the joins.

Null and empty texts have no words: they fail A alone and, of several, all but
that of the smallest id fail E. Texts that are null and empty are identical.
Rows without id are no copies and make none of others, and have no labels. Of
several labels for one id any counts. Repeated rows count each; of equal ids
with the smallest id of a text none is a copy. A null part is the empty string.
An empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import stage

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
STEPS = len(LETTERS)
COPY = 1 << LETTERS.index("E")
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = b"#$%&*|"
#: What is counted: all rows, rows labelled as good, rows labelled as toxic.
COUNTED = ("n", "good", "toxic")
#: Parts whose arrays a task holds before it sends them on.
HELD_PARTS = 500


def first_failures() -> np.ndarray:
    """By failures (bits) and order: the step that removes, from 1, or 0."""
    table = np.zeros((1 << STEPS, len(ORDERS)), np.int64)
    for o, order in enumerate(ORDERS):
        for step in range(STEPS, 0, -1):
            bit = 1 << LETTERS.index(order[step - 1])
            table[np.arange(len(table)) & bit > 0, o] = step
    return table


def failures_of(text: str) -> int:
    """Bits of A to D."""
    b = text.encode()
    words = b.split()  # of bytes: at ASCII white space
    a = len(words) < 50
    few = 100 * len(set(words)) < 65 * len(words)
    loud = 100 * (len(b) - len(b.translate(None, UPPER))) > 5 * len(text)
    signs = len(b.translate(None, SIGNS)) < len(b)
    return a | few << 1 | loud << 2 | signs << 3


def text_failures(text: Column) -> Column:
    """Which of A to D a text fails, as bits; a null text is empty."""

    @F.pandas_udf("int")
    def failures(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([failures_of(t or "") for t in texts], dtype="int32")

    return failures(text)


def count_removals(rows: DataFrame) -> DataFrame:
    """(part, filter_order, n_0 .. toxic_5): rows by the step that removes them, partial sums of each task.

    Of rows (part, failures, n, good, toxic), the last three being numbers of documents.
    """
    table = first_failures()
    cells = len(ORDERS) * (STEPS + 1)
    names = [f"{c}_{step}" for c in COUNTED for step in range(STEPS + 1)]

    def partial(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for part, counts in held.items():
            columns = counts.reshape(len(COUNTED), len(ORDERS), STEPS + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ORDERS)), pa.array(ORDERS), *(pa.array(columns[c, :, s]) for c in range(len(COUNTED)) for s in range(STEPS + 1))],
                names=["part", "filter_order", *names],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                parts = rows.column("part").dictionary_encode()
                code = parts.indices.to_numpy()
                steps = table[rows.column("failures").to_numpy()]
                keys = (code[:, None] * cells + np.arange(len(ORDERS)) * (STEPS + 1) + steps).ravel()
                size = len(parts.dictionary) * cells
                counts = [np.bincount(keys, np.repeat(rows.column(c).to_numpy(), len(ORDERS)), size).astype(np.int64) for c in COUNTED]
                by_part = np.stack(counts).reshape(len(COUNTED), -1, cells)
                for k, part in enumerate(parts.dictionary.to_pylist()):
                    held[part] = held[part] + by_part[:, k] if part in held else by_part[:, k].copy()
            if len(held) > HELD_PARTS:
                yield from partial(held)
                held = {}
        yield from partial(held)

    return rows.mapInArrow(count, f"part string, filter_order string, {', '.join(f'{x} long' for x in names)}")


def audit_filters(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
    quality_col: str = "quality", toxic_col: str = "toxic",
) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    facts = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), text_failures(text).alias("failures"),
    )
    facts = stage(facts, "filter-failures")
    rows = facts.groupBy("id", "digest", "part", "failures").agg(F.count("*").alias("n"))
    firsts = facts.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    ids = labels.groupBy(F.col(id_col).alias("id"))
    marks = ids.agg(F.max((F.col(quality_col) == 1).cast("int")).alias("good"), F.max((F.col(toxic_col) == 1).cast("int")).alias("toxic"))
    # rows without id meet nothing and stay out of the joins, where they would be one key
    known = rows.where("id is not null").join(firsts, ["id", "digest"], "left").join(marks, "id", "left")
    copy = F.when(F.col("first").isNull(), COPY).otherwise(0)
    zero = F.lit(0).cast("long")
    marked = known.select("part", (F.col("failures") + copy).alias("failures"), "n", *(F.coalesce(F.col(c) * F.col("n"), zero).alias(c) for c in COUNTED[1:]))
    counts = count_removals(marked.unionByName(rows.where("id is null").select("part", "failures", "n", zero.alias("good"), zero.alias("toxic"))))
    sums = counts.groupBy("part", "filter_order").agg(*(F.sum(c).alias(c) for c in counts.columns[2:]))
    steps = F.array(*(F.struct(*(F.col(f"{c}_{s}").alias(c) for c in COUNTED), sum(F.col(f"n_{k}") for k in (0, *range(s + 1, STEPS + 1))).alias("kept")) for s in range(1, STEPS + 1)))
    each = sums.select("part", "filter_order", F.posexplode(steps).alias("at", "x")).select(
        "part", "filter_order", (F.col("at") + 1).alias("step"), F.substring("filter_order", F.col("at") + 1, F.lit(1)).alias("filter"), "x.*"
    )
    own = Window.partitionBy("part", "filter")
    return each.select(
        "part", "filter_order", "step", "filter", "kept", F.col("n").alias("removed"),
        (F.max(F.when(F.col("step") == 1, F.col("n"))).over(own) - F.col("n")).alias("redundant"),
        F.max(F.when(F.col("step") == STEPS, F.col("n"))).over(own).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("n").over(own).alias("shapley"),
    )


def oracle() -> str:
    """The same rows in SQL, from every document's failures and every order."""
    letter = "letters(l) AS (VALUES " + ", ".join(f"('{c}')" for c in LETTERS) + ")"
    distinct = " AND ".join(f"{a}.l <> {b}.l" for a, b in ("ab", "ac", "ad", "ae", "bc", "bd", "be", "cd", "ce", "de"))
    return rf"""
WITH {letter},
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e WHERE {distinct}),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d JOIN firsts USING (t) LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
s AS (
  SELECT part, o, k, substr(o, k, 1) AS filter, fails, n, good, toxic,
    position(substr(o, k, 1) IN fails) > 0 AS hit, length(translate(substr(o, 1, k - 1), fails, '')) < k - 1 AS earlier
  FROM g, orders, range(1, 6) steps(k)),
r AS (
  SELECT part, o, k, filter, sum(n) FILTER (NOT hit AND NOT earlier) AS kept, sum(n) FILTER (hit AND NOT earlier) AS removed, sum(n) FILTER (hit AND earlier) AS redundant,
    sum(n) FILTER (fails = filter) AS unique_fails, sum(good) FILTER (hit AND NOT earlier) AS good_lost, sum(toxic) FILTER (hit AND NOT earlier) AS toxic_lost
  FROM s GROUP BY part, o, k, filter)
SELECT part, o AS filter_order, CAST(k AS INT) AS step, filter, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r"""
