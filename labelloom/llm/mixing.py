"""Mixing sources to target weights, in DataFrame operations alone.

Each source's words, in a fixed order of its documents, are cut into blocks.
Output shards have a fixed number of slots. For each shard a multinomial draw
says how many of its slots each source fills: every slot draws a source in
proportion to the targets. Slots of a source are numbered over all shards; the
number, through a pseudorandom permutation of the source's blocks that changes
with each pass over them, names the block. Slots that a source has drawn beyond
its target are dropped, and a closing shard holds those that it still lacks,
so a source's words meet its target to the word; the last slot takes only part
of its block. No pass takes a block twice, and no source has over two passes.

Order and prefix sums never need all documents of a source in one task:
documents fall into buckets by a hash of their id, are added up within a
bucket, and only bucket totals are added up along the source.

Sources share `share` times all words by weight. Weights repeat along the
sources in code point order, null last. A target stops at `most` times its
source; the rest goes to the other sources by weight until none is above.

Rows equal in id, source and all other columns are placed together and then dealt
out, so a row that is a third of the table fills no bucket alone. The table of
sources has a row for each and is ordered in one task: it is meant for up to
some millions of sources.

Null texts have size 0; they are returned with taken 0, and so are all rows of
a source or a table without words. Repeated rows are separate documents of their
source, with places of their own. An empty table gives no rows; other columns
only tell rows of one id apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import WORD, stage, with_broadcast_if_small

ROUNDS = 24
#: Beyond so many sources their table is joined by a shuffle.
BROADCAST_SOURCES = 50_000
#: Up to so many ids and hashes of repeated rows are broadcast.
BROADCAST_REPEATED = 500_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target, source_no) from one row a source.

    With caps sorted by cap over weight, the first sources in that order are
    capped: the level at which the rest shares what is left decides where.
    """
    everything = Window.partitionBy()
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    rise = Window.orderBy("full_at", "source_no")
    numbered = sizes.withColumn("source_no", F.row_number().over(in_order) - 1)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("source_no") % len(weights) + 1).cast("int"))
    leveled = (
        numbered.withColumn("weight", weight)
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("total", share * F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
    )
    settled = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source_no", "level"))).over(everything)
    return leveled.withColumn("level", F.coalesce(settled["level"], F.col("full_at"))).select(
        "source", "source_no", "source_size", "weight", F.least(F.col("cap"), F.col("weight") * F.col("level")).alias("target")
    )


def permuted(x: Column, n: Column, *key: Column, back: bool = False) -> Column:
    """Where a pseudorandom permutation of 0 .. n-1, or its inverse, takes x: swap or not, in rounds.

    A round pairs every index with its mirror image around a random centre, and
    a hash of the larger of the two says whether they swap. n below 1 counts as 1.
    """
    n = F.greatest(n, F.lit(1))

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *key), n) - at, n)
        return F.when(F.xxhash64(r, F.greatest(at, other), *key) % 2 == 0, other).otherwise(at)

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, x.cast("long"), swap)


def _slots(sources: DataFrame, count: int, shard_slots: int, seed: int, cells: int = 1024, lanes: int = 256) -> DataFrame:
    """(shard, source_no, k): slot k of a source, for every slot that the mix fills, from (source_no, slots) of `count` sources.

    A slot draws a point in the line of all targets; a grid of `cells` over the
    line finds the source by an equality join. Slots of a source are counted by
    shard, and by lanes of shards first, to number them.
    """
    spark = sources.sparkSession
    line = Window.orderBy("source_no")
    spans = (
        sources.withColumn("to", F.sum("slots").over(line))
        .withColumn("from", F.col("to") - F.col("slots"))
        .withColumn("all", F.sum("slots").over(Window.partitionBy()))
        .where("slots > 0")
    )
    total = spans.agg(F.max("all")).first()[0] or 0
    shards = -(-total // shard_slots)
    # a cell lists the sources whose span reaches into it
    grid = spans.select(
        "source_no", "from", "to", "slots",
        F.explode(F.sequence(F.floor(F.col("from") * cells / F.lit(max(total, 1))), F.floor((F.col("to") - 1) * cells / F.lit(max(total, 1))))).alias("cell"),
    )
    drawn = (
        spark.range(0, total)
        .select(F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(total, 1))).alias("u"))
        .withColumn("cell", F.floor(F.col("u") * cells / F.lit(max(total, 1))))
        .join(with_broadcast_if_small(grid, count, BROADCAST_SOURCES), "cell")
        .where("u >= `from` and u < `to`")
        .groupBy("shard", "source_no")
        .agg(F.count("*").alias("n"))
    )
    lane = drawn.withColumn("lane", F.floor(F.col("shard") * lanes / F.lit(max(shards, 1))))
    before = lane.groupBy("source_no", "lane").agg(F.sum("n").alias("lane_n"))
    ahead = Window.partitionBy("source_no").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("lane_from", F.coalesce(F.sum("lane_n").over(ahead), F.lit(0)))
    inside = Window.partitionBy("source_no", "lane").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counted = (
        lane.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(before, ["source_no", "lane"])
        .select("shard", "source_no", (F.col("lane_from") + F.col("first")).alias("first"), "n")
    )
    had = before.groupBy("source_no").agg(F.sum("lane_n").alias("had"))
    limit = spans.select("source_no", "slots")
    # the closing shard: pieces of what a source still lacks
    lack = (
        limit.join(had, "source_no", "left")
        .withColumn("had", F.coalesce("had", F.lit(0)))
        .where("had < slots")
        .select("source_no", F.explode(F.sequence(F.col("had"), F.col("slots") - 1, F.lit(shard_slots).cast("long"))).alias("first"), "slots")
        .select(F.lit(shards).cast("long").alias("shard"), "source_no", "first", F.least(F.lit(shard_slots), F.col("slots") - F.col("first")).alias("n"))
    )
    return (
        counted.unionByName(lack)
        .join(with_broadcast_if_small(limit, count, BROADCAST_SOURCES), "source_no")
        .withColumn("n", F.least(F.col("n"), F.col("slots") - F.col("first")))
        .where("n > 0")
        # few small rows that each become many: they are dealt to all tasks first
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "source_no")
        .select("shard", "source_no", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("k"))
    )


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns, but for maps, which have no order."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"))


def _one_by_one(placed: DataFrame, tasks: int, lane: int = 1000) -> DataFrame:
    """A row for each of the `copies` of a placed row, each with its own start; many copies of one row are dealt to all tasks."""
    many = placed.where("copies > 1").withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(lane).cast("long"))))
    many = many.repartition(tasks).withColumn("at", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + lane, F.col("copies")) - 1)))
    start = F.col("start") + F.col("at") * F.col("size")
    return placed.where("copies = 1").drop("copies").unionByName(many.withColumn("start", start).drop("copies", "from", "at"))


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 512,
    shard_slots: int = 256, buckets: int = 1024, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """The mixed documents and the pieces that the mix takes of them.

    First (id, row_hash, source, size, source_size, target, taken), one row for
    each input row; then (id, row_hash, source_no, start, shard, k, pass, from_word,
    to_word): pieces in slot k of the source, in words of the document that starts
    at that word of its source.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        row_hash(docs).alias("row_hash"), word_count(F.col(text_col)).alias("size"),
    )
    base = base.groupBy("doc_id", "source", "row_hash", "size").agg(F.count("*").alias("copies"))
    bucket = F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(buckets)).cast("int")
    order = Window.partitionBy("source", "bucket").orderBy("doc_id", "row_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_size = F.col("size") * F.col("copies")
    placed = stage(base.withColumn("bucket", bucket).withColumn("end", F.sum(all_size).over(order)), "mix-documents")
    totals = placed.groupBy("source", "bucket").agg(F.sum(all_size).alias("n"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sources = stage(source_targets(totals.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, most), "mix-sources")
    count = sources.count()
    offsets = totals.withColumn("offset", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    same_source = offsets["source"].eqNullSafe(sources["source"])
    offsets = offsets.join(with_broadcast_if_small(sources, count, BROADCAST_SOURCES), same_source).select(offsets["source"], "bucket", "offset", "source_no", "source_size", "target")
    o = offsets.alias("o")
    spread = (
        placed.alias("d")
        .join(o, F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.bucket") == F.col("o.bucket")))
        .select("d.doc_id", "d.row_hash", "d.source", "size", "source_no", "source_size", "target", "copies", (F.col("offset") + F.col("end") - all_size).alias("start"))
    )
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = stage(_one_by_one(stage(spread, "mix-groups"), tasks), "mix-placed")
    words = F.least(F.round("target"), F.floor(most * F.col("source_size"))).cast("long")
    budget = sources.select("source_no", "source_size", words.alias("words"))
    blocks = F.ceil(F.col("source_size") / block)
    short = F.col("source_size") - (blocks - 1) * block
    whole = F.floor(F.col("words") / F.greatest(F.col("source_size"), F.lit(1)))
    # slots of whole passes, then those of the pass that ends within the target
    plan = (
        budget.where("source_size > 0")
        .withColumn("blocks", blocks)
        .withColumn("short", short)
        .withColumn("passes", whole)
        .withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
        .withColumn("short_at", permuted(F.col("blocks") - 1, F.col("blocks"), F.lit(seed), F.col("source_no"), F.col("passes"), back=True))
    )
    rest_slots = F.ceil(F.col("rest") / block)
    # the short block may fall early, and one slot more is needed then
    rest_slots = F.when((F.col("short_at") < rest_slots) & (rest_slots * block - (block - F.col("short")) < F.col("rest")), rest_slots + 1).otherwise(rest_slots)
    plan = plan.withColumn("slots_needed", F.col("passes") * F.col("blocks") + rest_slots)
    slots = _slots(plan.select("source_no", F.col("slots_needed").alias("slots")), count, shard_slots, seed)
    known = plan.select("source_no", "blocks", "short", "passes", "rest", "short_at")
    start = F.col("at") * block - F.when(F.col("at") > F.col("short_at"), block - F.col("short")).otherwise(0)
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("short")).otherwise(F.lit(block))
    taken_slots = (
        slots.join(with_broadcast_if_small(known, count, BROADCAST_SOURCES), "source_no")
        .withColumn("pass", F.floor(F.col("k") / F.col("blocks")))
        .withColumn("at", F.col("k") % F.col("blocks"))
        .withColumn("block", permuted(F.col("at"), F.col("blocks"), F.lit(seed), F.col("source_no"), F.col("pass")))
        .withColumn("fill", F.when(F.col("pass") < F.col("passes"), length).otherwise(F.greatest(F.least(F.col("rest") - start, length), F.lit(0))))
        .where("fill > 0")
        .select("source_no", "block", "shard", "k", "pass", "fill")
    )
    segments = spread.where("size > 0").select(
        "doc_id", "row_hash", "source_no", "start", "size",
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"),
    )
    first = F.greatest(F.col("start"), F.col("block") * block)
    last = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("fill"))
    pieces = (
        segments.join(taken_slots, ["source_no", "block"])
        .select("doc_id", "row_hash", "source_no", "start", "shard", "k", "pass", (first - F.col("start")).alias("from_word"), (last - F.col("start")).alias("to_word"))
        .where("to_word > from_word")
    )
    got = pieces.groupBy("source_no", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    words_of = spread.where("size > 0").join(got, ["source_no", "start"], "left").select(*spread.columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    mixed = words_of.unionByName(spread.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    names = [F.col("doc_id").alias(id_col), "row_hash", F.col("source").alias(source_col), "size", "source_size", "target", "taken"]
    return mixed.select(*names), pieces.withColumnRenamed("doc_id", id_col)


def _one_of_each(texts: DataFrame) -> DataFrame:
    """One row of each id and row_hash.

    Which are repeated is found without the rows themselves, and those alone are
    shuffled; beyond BROADCAST_REPEATED of them all rows are.
    """
    keys = ["id", "row_hash"]
    again = stage(texts.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys), "mix-repeated")
    count = again.count()
    if not count:
        return texts
    if count > BROADCAST_REPEATED:
        return texts.dropDuplicates(keys)
    t, a = texts.alias("t"), F.broadcast(again).alias("a")
    same = F.col("t.id").eqNullSafe(F.col("a.id")) & (F.col("t.row_hash") == F.col("a.row_hash"))
    return t.join(a, same, "left_anti").unionByName(t.join(a, same, "left_semi").dropDuplicates(keys))


def mixed_documents(docs: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The mix as documents, with the columns of `docs`: one row a document and pass.

    A document that a pass takes whole stays as it is; of others the words taken
    remain, with a space between. The number of characters, if there is such a
    column, follows the text. Rows that share an id keep their own columns; only
    rows equal in all of them stand for each other. Texts are shuffled once.
    """
    parts = pieces.select(F.col(id_col).alias("id"), "row_hash", "source_no", "start", "pass", "from_word", "to_word")
    parts = parts.groupBy("id", "row_hash", "source_no", "start", "pass").agg(
        F.sum(F.col("to_word") - F.col("from_word")).alias("taken"),
        F.array_sort(F.collect_list(F.struct("from_word", "to_word"))).alias("spans"),
    )
    p = parts.alias("p")
    # the row is kept as one struct, so its columns may have any names
    texts = docs.select(F.col(id_col).alias("id"), row_hash(docs).alias("row_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    t = _one_of_each(texts).alias("t")
    joined = t.join(p, F.col("t.id").eqNullSafe(F.col("p.id")) & (F.col("t.row_hash") == F.col("p.row_hash"))).select("row", "taken", "spans")
    text = F.col("row")[text_col]
    cut = joined.where(F.col("taken") < word_count(text)).withColumn("words", F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)))
    span = F.transform("spans", lambda s: F.slice("words", (s["from_word"] + 1).cast("int"), (s["to_word"] - s["from_word"]).cast("int")))
    cut = cut.withColumn("row", F.col("row").withField(text_col, F.array_join(F.flatten(span), " "))).select("row")
    both = joined.where(F.col("taken") >= word_count(text)).select("row").unionByName(cut)
    if chars_col in docs.columns:
        both = both.withColumn("row", F.col("row").withField(chars_col, F.length(text).cast(docs.schema[chars_col].dataType)))
    return both.select("row.*")
