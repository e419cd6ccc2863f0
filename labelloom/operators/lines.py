"""Lines of text with boxes: adapters, merging of readings, reading order, neighbours.

A table of lines has package_id, index, text, confidence, box, source. After
`prepare` it also has pos (dense, from 0), form (for matching) and geo.
Everything is keyed by package_id, so one hash distribution serves all stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions import geometry as G
from labelloom.functions import text as T
from labelloom.operators import folds
from labelloom.staging import dealt, keyed, stage_keyed

LEAST_CONFIDENCE = 0.15
GROUP_READINGS = 6


def useful_readings(lines: DataFrame) -> DataFrame:
    """Readings worth keeping: confidence, some letter or digit, a box; with the adjusted confidence."""
    return lines.where((F.col("confidence") >= LEAST_CONFIDENCE) & T.is_useful(F.col("text")) & (F.size("box") > 0)).withColumn(
        "adjusted_confidence", T.adjusted_confidence(F.col("confidence"), F.col("text"), F.col("source"))
    )


LINE_OBJECT = "text string, confidence string, bbox string, source string, variant string"


def adapt(raw: DataFrame) -> DataFrame:
    """Lines (package_id, index, line) of mixed form as a table of lines; `line` is JSON text.

    An object has text, confidence, bbox, and source or else variant. An array of three or more is box, text and
    confidence. Anything else is text alone: a JSON string or number as its value, a shorter array or what isn't
    JSON as it stands. What is missing or not of its type (a word for a confidence, a box of fewer than four corners) gives
    null text, confidence 0, no box and source `unknown`, and never fails; null lines have null text, which
    `prepare` drops while the others keep their index.
    """
    line = F.col("line")
    whole = F.from_json(line, LINE_OBJECT)
    parts = F.from_json(line, "array<string>")
    is_object, is_tuple = F.json_object_keys(line).isNotNull(), F.coalesce(F.json_array_length(line), F.lit(0)) >= 3
    scalar = F.when(F.json_array_length(line).isNotNull(), line).when(F.trim(line) != "null", F.coalesce(F.get_json_object(line, "$"), line))

    def of(in_object: Column, at: int, otherwise: Column) -> Column:
        return F.when(is_object, in_object).when(is_tuple, F.get(parts, at)).otherwise(otherwise)

    confidence = of(whole["confidence"], 2, F.lit(None))
    box = F.from_json(of(whole["bbox"], 0, F.lit(None)), "array<array<double>>")
    told = raw.select(
        "package_id", "index", of(whole["text"], 1, scalar).alias("text"), F.when(confidence == "true", 1.0).otherwise(T.to_double(confidence)).alias("confidence"), box.alias("box"),
        F.when(is_object, F.coalesce(whole["source"], whole["variant"])).alias("source"),
    )
    is_box = (F.size("box") >= 4) & ~F.exists("box", lambda p: F.coalesce(F.size(p) != 2, F.lit(True)) | F.exists(p, lambda v: v.isNull()))
    return told.withColumns({"box": F.when(is_box, F.col("box")), "source": F.coalesce("source", F.lit("unknown"))})


def prepare(lines: DataFrame) -> DataFrame:
    """Lines with text, normal form and extent; index counts the blank ones that are dropped, pos does not."""
    order = Window.partitionBy("package_id").orderBy("index")
    return (
        keyed(lines).select(
            "package_id", "index", T.clean(F.col("text")).alias("text"), T.unit_clip(T.to_double(F.col("confidence").cast("string"))).alias("confidence"),
            "box", F.coalesce("source", F.lit("unknown")).alias("source"),
        )
        .where("text <> ''")
        .withColumn("pos", F.row_number().over(order) - 1)
        .withColumn("form", T.match_form(F.col("text")))
        .withColumn("geo", G.extent(F.col("box")))
    )


def dense_lines(lines: DataFrame) -> DataFrame:
    """(package_id, id from 1, text, confidence to four digits): what a semantic model is shown."""
    order = Window.partitionBy("package_id").orderBy("index")
    return (
        lines.select("package_id", "index", F.trim(F.coalesce("text", F.lit(""))).alias("text"), "confidence")
        .where("text <> ''")
        .select("package_id", F.row_number().over(order).alias("id"), "text", F.round(T.unit_clip(F.col("confidence")).cast("decimal(18,10)"), 4).cast("double").alias("confidence"))
    )


def prompt_lines(dense: DataFrame) -> DataFrame:
    """The numbered lines of a package as one text, in order."""
    line = F.struct("id", F.format_string("[%d] (%s) %s", "id", F.format_number("confidence", 2), "text").alias("line"))
    return dense.groupBy("package_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("prompt"))


def _placed(lines: DataFrame, *order: Column | str) -> DataFrame:
    """Lines in order as items of a fold; `first` is the number of the first of equal text and place."""
    centre, size = G.centre(F.col("box")), G.extent(F.col("box"))
    shape = {"x": centre["x"], "y": centre["y"], "x0": size["left"], "y0": size["top"], "x1": size["right"], "y1": size["bottom"]}
    package = Window.partitionBy("package_id")
    told = dealt(lines, "package_id").withColumns({"no": F.row_number().over(package.orderBy(*order)).cast("long"), "letters": T.unicode_alnum(F.col("text"))})
    told = told.withColumns({k: F.coalesce(c, F.lit(0.0)) for k, c in shape.items()})
    same = Window.partitionBy("package_id", "letters", *shape)
    # readings without letters resemble none
    told = told.withColumn("first", F.when(F.col("letters") != "", F.min("no").over(same)).otherwise(F.col("no")))
    return stage_keyed(told.withColumns({k: F.when(F.col("no") == F.col("first"), c) for k, c in folds.profile(F.col("letters")).items()}), "placed-lines")


def merge_readings(lines: DataFrame, tile: int = folds.TILE) -> DataFrame:
    """Readings of all passes as one list: (package_id, merge_no, text, confidence, adjusted_confidence, box, source).

    Readings go by adjusted confidence, then length, then index. One is dropped if it is
    nearly a kept one's text at nearly its place. The rest gather around the
    first reading of similar text within 35 pixels, six of them at most.
    Equal readings are dropped first, the others folded by links of place and text, in tiles, so a package may be of any size.
    """
    text = T.clean(F.col("text"))
    told = lines.where(text != "").withColumn("text", text)
    told = _placed(told, F.desc("adjusted_confidence"), F.desc(F.length("text")), "index").where("no = first")
    near = folds.within(told, 15.0, 0.90).unionByName(folds.overlapping(told, 0.35, 0.90))
    dropped = folds.joining(stage_keyed(folds.resembling(near, 0.90), "links"), tile)
    kept = stage_keyed(told.join(dropped, ["package_id", "no"], "left_anti"), "kept-readings")
    grouped = folds.homes(kept, folds.resembling(folds.within(kept, 35.0, 0.72), 0.72), tile)
    group = Window.partitionBy("package_id", "home").orderBy("no")
    full = grouped.withColumn("_at", F.row_number().over(group)).where(F.col("_at") <= GROUP_READINGS)
    number = F.row_number().over(Window.partitionBy("package_id").orderBy("home", "no")) - 1
    return full.select("package_id", number.cast("long").alias("merge_no"), "text", "confidence", "adjusted_confidence", "box", "source")


def reading_order(lines: DataFrame) -> DataFrame:
    """With row and reading_no: rows of 0.65 median heights (12 pixels at least), then height, then left to right."""
    package = Window.partitionBy("package_id")
    c, d = G.centre(F.col("box")), G.dimensions(F.col("box"))
    typical = F.coalesce(F.median(F.when(F.col("_h") > 0, F.col("_h"))).over(package), F.lit(20.0))
    return (
        lines.withColumn("_x", c["x"])
        .withColumn("_y", c["y"])
        .withColumn("_h", d["h"])
        .withColumn("row", F.bround(F.col("_y") / F.greatest(F.lit(12.0), typical * 0.65)).cast("long"))
        .withColumn("reading_no", F.row_number().over(package.orderBy("row", "_y", "_x", "index")))
        .drop("_x", "_y", "_h")
    )


def ranked_neighbours(lines: DataFrame, gaps: tuple[float, ...], most: int = 8) -> DataFrame:
    """(package_id, i, j, distance, ranks): pairs of lines near each other, with their rank under each gap.

    With boxes: vertical distance, the gap at most, and 0.35 of the horizontal.
    Bands of the largest gap bound the pairs that are compared, and one pass
    over them ranks for all gaps. Where either has no box the distance is that
    of the positions, and only those pairs are made that can come among the
    `most` nearest: for a line, the `most` next lines without box on either side,
    and for one without, also the `most` next of any kind. So ranks hold up to
    `most`. A rank is null where the gap is too small for the pair.
    """
    gap = max(gaps)
    slim = lines.select("package_id", "pos", F.col("geo.x").alias("x"), F.col("geo.y").alias("y"))
    boxed = slim.where("y is not null").withColumn("band", F.floor(F.col("y") / gap).cast("long"))
    a = boxed.select("package_id", F.col("pos").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    b = boxed.select("package_id", "band", F.col("pos").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    rise = F.abs(F.col("yj") - F.col("yi"))
    near = (
        a.join(b, ["package_id", "band"])
        .where((F.col("i") != F.col("j")) & (rise <= gap))
        .select("package_id", "i", "j", (rise + 0.35 * F.abs(F.col("xj") - F.col("xi"))).alias("distance"), rise.alias("rise"))
    )
    # lines without box are numbered, so that the next of them on either side are known by number
    before = Window.partitionBy("package_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = slim.select("package_id", "pos", F.col("y").isNull().alias("bare"), F.count_if(F.col("y").isNull()).over(before).alias("no"))
    bare = counted.where("bare").select("package_id", "no", F.col("pos").alias("j"))
    to_bare = counted.select("package_id", F.col("pos").alias("i"), F.explode(F.sequence(F.col("no") - most, F.col("no") + most)).alias("no")).join(bare, ["package_id", "no"])
    others = counted.where("not bare").select("package_id", F.col("pos").alias("j"))
    around = counted.where("bare").select("package_id", F.col("pos").alias("i"), F.explode(F.sequence(F.col("pos") - most, F.col("pos") + most)).alias("j"))
    odd = to_bare.select("package_id", "i", "j").where("i <> j").unionByName(around.join(others, ["package_id", "j"]).select("package_id", "i", "j"))
    odd = odd.select("package_id", "i", "j", F.abs(F.col("i") - F.col("j")).cast("double").alias("distance"), F.lit(0.0).alias("rise"))
    order = Window.partitionBy("package_id", "i").orderBy("distance", "j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = F.array(*(F.when(F.col("rise") <= g, F.count_if(F.col("rise") <= g).over(order).cast("int")) for g in gaps))
    return near.unionByName(odd).select("package_id", "i", "j", "distance", ranks.alias("ranks"))


def neighbours(lines: DataFrame, count: int = 5, gap: float = 180.0) -> DataFrame:
    """(package_id, i, j, distance, rank): the nearest `count` lines of each line, by pos."""
    told = ranked_neighbours(lines, (gap,), count).withColumn("rank", F.col("ranks")[0])
    return told.where(F.col("rank") <= count).drop("ranks")


def duplicate_reading(a: Column, b: Column, similarity: Column) -> Column:
    """Whether two readings (structs with box) of a given text similarity are the same print."""
    da, db = G.dimensions(a["box"]), G.dimensions(b["box"])
    scale = F.greatest(F.lit(10.0), da["h"], db["h"], da["w"] * 0.08, db["w"] * 0.08)
    close = (G.overlap(a["box"], b["box"]) >= 0.20) | (G.centre_distance(a["box"], b["box"]) <= F.greatest(F.lit(18.0), scale * 1.8))
    return (similarity >= 0.72) & close


def reading_clusters(lines: DataFrame, least: float = 0.55, reach: float = 60.0, tile: int = folds.TILE) -> DataFrame:
    """(package_id, index, cluster): first fit in order by text similarity and distance, to look at readings.

    Equal readings go with their first one; the others are folded by links, in tiles, so a package may be of any size.
    """
    told = _placed(lines.withColumn("index", F.col("index").cast("long")), "index")
    different = told.where("no = first").select("package_id", "no", "x", "y", *folds.TEXT)
    found = folds.homes(different, folds.resembling(folds.within(different, reach, least), least), tile).select("package_id", F.col("no").alias("first"), "home")
    number = F.dense_rank().over(Window.partitionBy("package_id").orderBy("home")) - 1
    return told.select("package_id", "index", "first").join(found, ["package_id", "first"]).select("package_id", "index", number.cast("long").alias("cluster"))
