"""Near duplicates by MinHash bands, verified by odd sketches and full sets.

A text's set is that of its different shingles of `width` words. Equal sets
fall together first, by a 128-bit sum, so a group of exact copies of any size
goes on as one representative. MinHash samples of the representatives are
banded; what shares a band is a candidate.

Candidates are verified in steps, and never as all pairs of a bucket. In each
bucket the most central member (the one with most company in all its buckets)
is the hub, and every member is compared with it: linear work, which joins
most of a large group. Members of one bucket that are still in different
components are open; of these, pairs from different components that share one
of their rarest shingles are compared. What decides:

* an odd sketch: the MinHash samples folded into a parity bitmap; the bits in
  which two bitmaps differ estimate how many samples differ. Pairs six standard
  deviations off are dropped;
* the same for the whole set: the bits in which two parity bitmaps differ never
  outnumber the shingles in which the sets differ, so no link is dropped here;
* the full sets of the pairs that are left.

Links go into components by alternating large and small stars.

Null texts and texts without words have no set and no links. Texts of fewer
words than a shingle are one shingle of all their words. Rows are judged each
by its own text, also where several texts share an id: repeated rows are copies
of each other, kept by their id. A null id takes no part: component null, kept.
Ids are integers. An empty table gives no rows; other columns don't matter.

Banding misses a pair at the threshold of 0.8 with a chance of 1e-7 or less.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import join_spread, stage, with_broadcast_if_small
from labelloom.sources.store import with_numbers

BANDS, ROWS = 32, 4
SAMPLE_BITS, SET_BITS = 512, 1024
CACHED_WORDS = 100_000
#: Rows up to which a table of ids is broadcast.
BROADCAST_ROWS = 500_000
#: Pairs of a hub for which one copy of its set is sent.
SPREAD = 1024
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's different shingles."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, at ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > CACHED_WORDS:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width, salt = min(width, len(words)), min(width, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
    return np.unique(_mixed(out, salt))


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(9)
    a = rng.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64)


def _parity(x: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits((np.bincount((x % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def sketch_of(text: str | None, width: int) -> tuple:
    s = shingles(text, width)
    if not len(s):
        return 0, 0, 0, None, None, None
    a, b = _functions()
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        low = np.minimum(low, ((s[None, at : at + 2048] * a + b) >> np.uint64(16)).min(axis=1))
    place = np.arange(BANDS * ROWS, dtype=np.uint64)
    marked = _mixed(low + place * np.uint64(0x9E3779B97F4A7C15))
    band = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        band = _mixed(band * np.uint64(31) + marked.reshape(BANDS, ROWS)[:, r])
    total = np.array([s.sum(), _mixed(s, 77).sum()]).view(np.int64)
    return len(s), int(total[0]), int(total[1]), band.view(np.int64), _parity(marked, SAMPLE_BITS), _parity(s, SET_BITS)


def sketches(text: Column, width: int) -> Column:
    """struct of set size, set sums, band keys and the two parity bitmaps."""

    @F.pandas_udf("n long, s1 long, s2 long, bands array<long>, samples array<long>, parity array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([sketch_of(t, width) for t in texts], columns=["n", "s1", "s2", "bands", "samples", "parity"])
        _words.clear()  # workers outlive their task

    return sketch(text)


def shingle_sets(text: Column, width: int) -> Column:
    @F.pandas_udf("array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(t, width).view(np.int64) for t in texts])
        _words.clear()

    return sets(text)


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that the edges (a, b) reach; nodes without an edge aren't listed."""
    e = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stage(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = stage(small.where("a <> b").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def _differing(a: str, b: str, size: int) -> Column:
    """Bits in which two bitmaps differ."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(a).getItem(i).bitwiseXOR(F.col(b).getItem(i))) for i in range(size // 64)))


def _close(a: str, b: str, percent: int) -> Column:
    """Whether a pair of sketches may be of texts at the threshold or over it."""
    t = percent / 100
    samples = BANDS * ROWS
    most = 2 * (samples * (1 - t) + 6 * (samples * t * (1 - t)) ** 0.5)
    # |A ^ B| = (|A| + |B|) (1 - J) / (1 + J)
    apart = _differing(f"{a}.parity", f"{b}.parity", SET_BITS) * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent)
    return apart & (_differing(f"{a}.samples", f"{b}.samples", SAMPLE_BITS) <= int(most))


def _sets_of(nodes: DataFrame, classes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(node, s): the full sets of some classes, each made anew from the text of its representative."""
    wanted = classes.join(with_broadcast_if_small(nodes, nodes.count(), BROADCAST_ROWS), "node").select("node", "rep", "rep_hash")
    wanted = stage(wanted, "wanted").alias("w")
    t = texts.alias("t")
    same = (F.col("t.doc_id") == F.col("w.rep")) & (F.xxhash64("t.text") == F.col("w.rep_hash"))
    found = t.join(with_broadcast_if_small(wanted, nodes.count(), BROADCAST_ROWS), same).select("w.node", "t.text")
    sets = found.select("node", shingle_sets(F.col("text"), width).alias("s"))
    return stage(sets.dropDuplicates(["node"]), "sets")  # the row itself may be repeated


def _similar(common: Column, x: Column, y: Column, percent: int) -> Column:
    return 100 * common >= percent * (x + y - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    A set b in many pairs is copied for every SPREAD of them, so that no task
    gets all the pairs of a hub.
    """
    pairs = stage(pairs.distinct(), "pairs")
    often = stage(pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > SPREAD), "hubs")
    copies = often.select("b", F.ceil(F.col("n") / SPREAD).cast("int").alias("copies"))
    copies = with_broadcast_if_small(copies, copies.count(), BROADCAST_ROWS)
    dealt = pairs.join(copies, "b", "left").withColumn("copy", F.pmod(F.xxhash64("a"), F.coalesce("copies", F.lit(1))))
    right = sets.withColumnRenamed("node", "b").join(copies, "b", "left")
    right = right.select("b", F.col("s").alias("sb"), F.explode(F.sequence(F.lit(0).cast("long"), (F.coalesce("copies", F.lit(1)) - 1).cast("long"))).alias("copy"))
    left = dealt.select("a", "b", F.col("copy").cast("long").alias("copy")).join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return left.join(right, ["b", "copy"]).where(_similar(common, F.size("sa"), F.size("sb"), percent)).select("a", "b")


def _apart(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of open members, from different components, that may be similar.

    Two similar sets have one of their rarest shingles in common, of as many as
    one may lack and one more (in any order that all share; rarest first makes
    the keys short). What many texts share is no key of any of them then. Under
    a key every pair has a member outside its largest component, so only those
    are compared with all: a group already joined costs nothing. Places in the
    order and sketches decide inside the join, which emits only what they leave.
    """
    each = sets.join(open_.select("node", "component", "k"), "node")
    shingled = stage(each.select("node", "component", F.col("k.n").alias("n"), F.explode("s").alias("g")), "open-shingles")
    common = stage(shingled.groupBy("g").agg(F.count("*").alias("f")).where("f > 1"), "open-frequencies")
    met = join_spread(shingled, common, ["g"], "f")
    rarest = Window.partitionBy("node").orderBy("f", "g")
    # shingles of one text alone come first in its order and match nothing
    keep = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.count("*").over(Window.partitionBy("node")))
    keys = met.withColumn("place", F.row_number().over(rarest)).withColumn("keep", keep)
    # where g stands in the whole order, those of one text alone included
    at = (F.col("n") - F.count("*").over(Window.partitionBy("node")) + F.col("place")).alias("at")
    keys = keys.select("node", "component", "g", "place", "keep", at).where("place <= keep").drop("place", "keep")
    keys = stage(keys, "open-keys")
    parts = keys.groupBy("g", "component").agg(F.count("*").alias("n"))
    largest = parts.groupBy("g").agg(F.max(F.struct("n", "component"))["component"].alias("largest"), F.count("*").alias("parts"), F.sum("n").alias("f"))
    copies = F.ceil(F.col("f") / SPREAD).cast("long").alias("copies")
    largest = stage(largest.where("parts > 1").select("g", "largest", "f", copies), "open-parts")
    seen = stage(join_spread(keys, largest, ["g"], "f"), "open-seen").join(open_.select("node", "k"), "node")
    copy = F.pmod(F.xxhash64("node"), F.col("copies")).alias("copy")
    x = seen.where("component <> largest").select("g", copy, F.struct("node", "component", "at").alias("x"), F.col("k").alias("kx"))
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    y = seen.select("g", copy, F.struct("node", "component", "at").alias("y"), F.col("k").alias("ky"))
    # what comes before g in either order is not in both sets
    most = F.least(F.col("kx.n") - F.col("x.at"), F.col("ky.n") - F.col("y.at")) + 1
    enough = most * (100 + percent) >= percent * (F.col("kx.n") + F.col("ky.n"))
    may = (F.col("x.component") != F.col("y.component")) & enough & _close("kx", "ky", percent)
    return x.join(y, ["g", "copy"]).where(may).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _plausible(pairs: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches don't rule them out."""
    return (
        pairs.join(sketched.select(F.col("node").alias("a"), F.col("k").alias("ka")), "a")
        .join(sketched.select(F.col("node").alias("b"), F.col("k").alias("kb")), "b")
        .where(_close("ka", "kb", percent))
        .select("a", "b")
    )


def _classes(rows: DataFrame) -> DataFrame:
    """One row a set: (node, n, s1, s2, copies, rep, rep_hash), nodes numbered in the order of their smallest ids."""
    first = F.min(F.struct("doc_id", "text_hash"))
    told = rows.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(first.alias("first"), F.count("*").alias("copies"))
    told = told.select("n", "s1", "s2", "copies", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("rep_hash"))
    return stage(with_numbers(told, 0, "rep", "rep_hash", "s1", "s2").withColumnRenamed("id", "node").drop("inspection_id"), "classes")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, n_shingles, component_id, kept, leads) of every row.

    `kept` is true for the rows of the component's smallest id; `leads` for those
    of them that are one text, of several that share this id the one of the
    smallest hash. Rows without links or without id lead.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stage(texts.select("doc_id", F.xxhash64("text").alias("text_hash"), sketches(F.col("text"), width).alias("s")).select("doc_id", "text_hash", "s.*"), "sketches")
    classes = _classes(rows)
    own = rows.drop("n", "s1", "s2").withColumnsRenamed({"doc_id": "rep", "text_hash": "rep_hash"})
    reps = stage(
        own.join(classes.select("node", "n", "rep", "rep_hash"), ["rep", "rep_hash"]).select("node", "n", "bands", "samples", "parity").dropDuplicates(["node"]),
        "representatives",
    )
    banded = stage(reps.select("node", F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("key")), "banded")
    shared = stage(banded.groupBy("key").agg(F.count("*").alias("company")).where("company > 1"), "buckets")
    members = stage(join_spread(banded, shared, ["key"], "company"), "bucket-members")
    central = members.groupBy("node").agg(F.sum("company").alias("score"))
    hubs = members.join(central, "node").groupBy("key").agg(F.max(F.struct(F.col("score"), (-F.col("node")).alias("less"))).alias("best"), F.max("company").alias("company"))
    hubs = stage(hubs.select("key", (-F.col("best.less")).alias("hub"), "company"), "hubs")
    sketched = reps.select("node", F.struct("n", "samples", "parity").alias("k"))

    pairs = join_spread(members.select("key", "node"), hubs, ["key"], "company").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = stage(_plausible(pairs, sketched, percent), "hub-pairs")
    met = stage(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "met")
    links = stage(_confirmed(pairs, _sets_of(met, classes, texts, width), percent), "links")
    found = connected(links)

    # what is still apart in a bucket; members of one component need no comparison
    placed = members.join(found.withColumnRenamed("node", "n").withColumnRenamed("component", "c"), F.col("node") == F.col("n"), "left")
    placed = stage(placed.select("key", "node", F.coalesce("c", "node").alias("component")), "placed-members")
    open_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("company")).where("low < high")
    open_keys = stage(open_keys.select("key", "company"), "open-buckets")
    open_nodes = stage(join_spread(placed, open_keys, ["key"], "company").select("node", "component").distinct(), "open-nodes")
    open_ = stage(open_nodes.join(sketched, "node"), "open-members")
    sets = _sets_of(open_.select("node"), classes, texts, width)
    more = stage(_confirmed(_apart(open_, sets, percent), sets, percent), "links")
    if not more.isEmpty():
        found = connected(links.unionByName(more))

    # numbers follow the smallest ids, so the smallest node of a component is that of its smallest id
    component = classes.join(found, "node", "left").select("n", "s1", "s2", "copies", "node", F.coalesce("component", "node").alias("top"))
    tops = classes.select(F.col("node").alias("top"), F.col("rep").alias("label"), F.col("rep_hash").alias("label_hash"))
    sizes = component.groupBy("top").agg(F.count("*").alias("classes"))
    tops = stage(tops.join(sizes, "top"), "components")
    labels = stage(join_spread(component, tops, ["top"], "classes").select("n", "s1", "s2", "copies", "label", "label_hash"), "labels")
    with_set = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    slim = rows.select("doc_id", "text_hash", "n", "s1", "s2")
    linked = join_spread(slim.where(with_set), labels, ["n", "s1", "s2"], "copies").select("doc_id", "text_hash", "n", "label", "label_hash")
    alone = slim.where(~with_set).select("doc_id", "text_hash", "n", F.col("doc_id").alias("label"), F.col("text_hash").alias("label_hash"))
    kept = F.col("doc_id").eqNullSafe(F.col("label"))
    return linked.unionByName(alone).select(
        F.col("doc_id").alias(id_col), "text_hash", F.col("n").alias("n_shingles"), F.col("label").alias("component_id"), kept.alias("kept"),
        (kept & (F.col("text_hash") == F.col("label_hash"))).alias("leads"),
    )


def oracle(percent: int = 80) -> str:
    """The same rows in SQL for shingles of two words: all pairs that share one are counted."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
q AS (SELECT doc_id, n, i, x, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM p),
s AS (SELECT DISTINCT doc_id, CASE WHEN n = 1 THEN x ELSE x || ' ' || y END AS g FROM q WHERE y IS NOT NULL OR n = 1),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
-- of two similar sets each has a fifth at most that the other lacks, so a few of its rarest shingles hold a common one
f AS (SELECT g, count(*) AS f FROM s GROUP BY g),
r AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS k FROM s JOIN f USING (g)),
few AS (SELECT r.doc_id, r.g FROM r JOIN c USING (doc_id) WHERE k <= n - ceil(n * {percent} / 100.0) + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM few a JOIN few b USING (g) WHERE a.doc_id < b.doc_id),
common AS (SELECT a, b, count(*) AS m FROM cand JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.g = x.g GROUP BY a, b),
link AS (SELECT a, b FROM common JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * m >= {percent} * (ca.n + cb.n - m)),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT m.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept
FROM m LEFT JOIN c ON c.doc_id = m.doc_id
"""
