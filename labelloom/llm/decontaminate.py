"""Benchmark decontamination by winnowing, in DataFrame operations alone.

Both sides are cut into words and every k words hashed. Of every w consecutive
hashes the smallest is kept as a fingerprint: any span of k + w - 1 words that
two texts share gives both of them the same minimum, so a shared window of
that length can't be missed. Documents whose fingerprints meet those of the
benchmark are read again, and the hits are extended: the windows around a
shared fingerprint are compared with the items' windows, word for word.

An item of fewer words than a window, but of one at least, is a window as a
whole; for each such length that occurs the documents' hashes of that length
are all fingerprints, without winnowing.

Null texts have no words, as have texts of separators only: such documents are
clean and such items are in no document. Repeated documents are judged each;
items that share an id are one item, as are those without id: their windows hit and
count as one item, which the digest of ids leaves out. No benchmark, no hits. An empty
table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import stage, with_broadcast_if_small

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows up to which a table of hashes or ids is broadcast: below 100 MB.
BROADCAST_ROWS = 2_000_000


def words_of(text: Column) -> Column:
    """Lower-case words; A-Z only are lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.split(F.trim(F.regexp_replace(low, SEPARATORS, " ")), " ")


def _starts(words: Column, length: Column | int) -> Column:
    """0-based starts of the runs of so many words; none where there are fewer."""
    last = F.size(words) - length
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _run_hash(words: Column, start: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), F.slice(words, start + 1, length))


def _hashes(words: Column, length: int) -> Column:
    return F.transform(_starts(words, length), lambda i: _run_hash(words, i, length))


def _winnowed(hashes: Column, w: int) -> Column:
    """Minima of every w consecutive hashes."""
    return F.array_distinct(F.transform(_starts(hashes, w), lambda i: F.array_min(F.slice(hashes, i + 1, w))))


def mark_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 6, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", share: int = 20,
) -> DataFrame:
    """(id, text hash, n_words, n_hit, n_items, items_sha256, contaminated) of every row.

    A row is contaminated if a word of it is hit, and one in `share` at least.
    """
    w = window - k + 1
    empty = F.array().cast("array<bigint>")
    # the benchmark: words, and per item the windows it consists of
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where(
        F.element_at("words", 1) != ""
    )
    items = stage(items.distinct(), "benchmark-words")
    n = F.size("words")
    short = sorted(r[0] for r in items.where(n < window).select(n).distinct().collect())  # below `window` lengths at most
    lengths = [*short, window]
    windows = stage(
        items.select("item", "words", F.least(n, F.lit(window)).alias("length"))
        .select("item", "length", F.explode(F.transform(_starts(F.col("words"), F.col("length")), lambda i: F.array_join(F.slice("words", i + 1, F.col("length")), " "))).alias("run"))
        .groupBy("length", "run")
        .agg(F.collect_set(F.struct("item")).alias("items")),  # a struct, as sets leave nulls out
        "benchmark-windows",
    )
    # hashes stand in a column of their own: inside the lambda they would be made anew for each start
    hashed = items.select("words", _hashes(F.col("words"), k).alias("hashes"))
    of_item = F.when(n >= window, _winnowed(F.col("hashes"), w)).otherwise(empty)
    for length in short:
        of_item = F.when(n == length, F.array(_run_hash(F.col("words"), F.lit(0), length))).otherwise(of_item)
    prints = stage(hashed.select(F.explode(of_item).alias("h")).distinct(), "benchmark-prints")
    n_prints = prints.count()

    # documents: their fingerprints, and those that the benchmark has too
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), words_of(F.col(text_col)).alias("words"))
    own = _winnowed(F.col("hashes"), w)
    if short:
        own = F.array_distinct(F.concat(own, *(_hashes(F.col("words"), length) for length in short)))
    table = stage(
        texts.withColumn("hashes", _hashes(F.col("words"), k)).select("doc_id", "text_hash", F.when(F.element_at("words", 1) == "", 0).otherwise(F.size("words")).cast("long").alias("n_words"), own.alias("prints")),
        "document-prints",
    )
    shared = stage(
        table.select("doc_id", "text_hash", F.explode("prints").alias("h"))
        .join(with_broadcast_if_small(prints, n_prints, BROADCAST_ROWS), "h", "left_semi")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("h").alias("shared")),
        "shared-prints",
    )
    n_shared = shared.count()

    # the windows around a shared fingerprint, once for each different document
    s = with_broadcast_if_small(shared, n_shared, BROADCAST_ROWS // 20).alias("s")
    again = (
        texts.alias("t")
        .join(s, F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t.text_hash") == F.col("s.text_hash")))
        .select("t.doc_id", "t.text_hash", "words", "shared")
        .dropDuplicates(["doc_id", "text_hash"])
    )

    def near(length: int) -> Column:
        """Starts of the windows that hold a shared fingerprint."""
        if length < window:
            return F.filter(_starts(F.col("words"), length), lambda i: F.array_contains("shared", _run_hash(F.col("words"), i, length)))
        at = F.filter(_starts(F.col("words"), k), lambda i: F.array_contains("shared", _run_hash(F.col("words"), i, k)))
        around = F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(i - (window - k), F.lit(0)), F.least(i, F.size("words") - window))))
        return F.when(F.size("words") >= window, F.array_distinct(around)).otherwise(F.array().cast("array<int>"))

    candidates = [
        again.select("doc_id", "text_hash", "words", F.explode(near(length)).alias("start")).select(
            "doc_id", "text_hash", "start", F.lit(length).alias("length"), F.array_join(F.slice("words", F.col("start") + 1, length), " ").alias("run")
        )
        for length in lengths
    ]
    runs = candidates[0]
    for more in candidates[1:]:
        runs = runs.unionByName(more)
    n_windows = windows.count()
    found = runs.join(with_broadcast_if_small(windows, n_windows, BROADCAST_ROWS // 10), ["length", "run"])
    # a document's own starts and items: no more than its words, and than the benchmark
    covered = F.flatten(F.transform(F.collect_set(F.struct("start", "length")), lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1)))
    hits = found.groupBy("doc_id", "text_hash").agg(
        F.size(F.array_distinct(covered)).cast("long").alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    hits = hits.select("doc_id", "text_hash", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.filter(F.transform("items", lambda x: x["item"]), lambda x: x.isNotNull())), ","), 256).alias("items_sha256"))
    h = hits.alias("h")
    judged = table.drop("prints").alias("d").join(h, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_hash") == F.col("h.text_hash")), "left")
    return judged.select(
        F.col("d.doc_id").alias(id_col), "d.text_hash", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def oracle(window: int = 13, share: int = 20) -> str:
    """The same rows in SQL, every window of every document compared."""
    words = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, least(len(w), {window}) AS n, array_to_string(w[s:s + least(len(w), {window}) - 1], ' ') AS run
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS s FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM iw),
dp AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS s FROM d),
dl AS (SELECT doc_id, s, list(word) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS run FROM dp),
dw AS (SELECT doc_id, s, n, array_to_string(run[1:n], ' ') AS run FROM dl, lengths WHERE len(run) >= n),
found AS (SELECT doc_id, s, n, item FROM dw JOIN iw USING (n, run)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM found)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {share} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
