"""Folds by links against plain folds in order."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from labelloom.functions.similarity import ratio
from labelloom.operators import lines as L

LINE = "package_id bigint, index int, text string, confidence double, box array<array<double>>, source string"


def box(x: float, y: float, w: float = 100.0, h: float = 20.0) -> list[list[float]]:
    x, y = float(x), float(y)
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]


def resembles(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return 0.75 + 0.25 * min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else ratio(a, b)


def apart(a, b) -> float:
    return sum((u - v) ** 2 for u, v in zip(a["c"], b["c"], strict=True)) ** 0.5


def overlap(a, b) -> float:
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = a["e"], b["e"]
    common = max(0.0, min(ax1, bx1) - max(ax0, bx0)) * max(0.0, min(ay1, by1) - max(ay0, by0))
    union = (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - common
    return common / union if union > 0 else 0.0


def item(row) -> dict:
    xs, ys = ([p[at] for p in row["box"]] for at in (0, 1)) if row["box"] else ([], [])
    n = len(xs)
    edges = (min(xs), min(ys), max(xs), max(ys)) if n >= 4 else (0.0,) * 4
    letters = "".join(c for c in row["text"].lower() if c.isalnum())
    return {**row.asDict(), "c": (sum(xs) / n, sum(ys) / n) if n else (0.0, 0.0), "e": edges, "letters": letters}


def merged(rows) -> list[int]:
    kept, groups = [], []
    for r in sorted(map(item, rows), key=lambda r: (-r["adjusted_confidence"], -len(r["text"]), r["index"])):
        if all((apart(r, k) > 15 and overlap(r, k) < 0.35) or resembles(r["letters"], k["letters"]) < 0.90 for k in kept):
            kept.append(r)
    for r in kept:
        home = next((g for g in groups if apart(r, g[0]) <= 35 and resembles(r["letters"], g[0]["letters"]) >= 0.72), None)
        if home is None:
            groups.append([r])
        elif len(home) < 6:
            home.append(r)
    return [(r["text"], r["confidence"], r["box"]) for g in groups for r in g]


def clusters(rows, least, reach) -> dict[int, int]:
    openers, out = [], {}
    for r in sorted(map(item, rows), key=lambda r: r["index"]):
        at = next((n for n, g in enumerate(openers) if apart(r, g) <= reach and resembles(r["letters"], g["letters"]) >= least), None)
        if at is None:
            at = len(openers)
            openers.append(r)
        out[r["index"]] = at
    return out


def readings(seed: int, packages: int = 12, n: int = 40):
    rng = random.Random(seed)
    words = ["black", "masoor", "net", "weight", "batch", "lot", "mrp", "rs", "50", "blcak", "masor"]
    rows = []
    for p in range(packages):
        for i in range(n):
            text = rng.choice(["", "??", "é", " ".join(rng.choices(words, k=rng.randint(1, 4)))] if rng.random() < 0.1 else [" ".join(rng.choices(words[:6], k=rng.randint(1, 3)))])
            where = None if rng.random() < 0.1 else box(rng.randint(0, 60), rng.randint(0, 60), rng.choice([0, 3, 16, 64, 100, 250]), rng.choice([0, 4, 10, 20, 60]))
            rows.append((p, i, text, round(rng.random(), 1), where[:3] if where and rng.random() < 0.05 else where, rng.choice(["original", "enhanced"])))
    return rows


def test_readings_merged_and_clustered_by_brute_force(spark):
    rows = readings(3) + [(99, 0, "alone", 0.5, box(0, 0), "original"), (100, 0, "", 0.5, None, "original")]
    told = spark.createDataFrame(rows, LINE).withColumn("adjusted_confidence", F.col("confidence"))
    by_package: dict = {}
    for r in told.collect():
        by_package.setdefault(r["package_id"], []).append(r)
    want = {p: merged([r for r in found if r["text"].strip()]) for p, found in by_package.items()}
    assert any(len(w) > 6 for w in want.values())
    for tile in (40, 50_000):  # several tiles a package, and one
        got: dict = {}
        for r in L.merge_readings(told, tile).orderBy("package_id", "merge_no").collect():
            got.setdefault(r["package_id"], []).append((r["text"], r["confidence"], r["box"]))
        assert got == {p: w for p, w in want.items() if w}
        seen: dict = {}
        for r in L.reading_clusters(told, tile=tile).collect():
            seen.setdefault(r["package_id"], {})[r["index"]] = r["cluster"]
        assert seen == {p: clusters(found, 0.55, 60.0) for p, found in by_package.items()}


def test_boxes_of_all_sizes_that_overlap(spark):
    from labelloom.operators import folds

    rng = random.Random(5)
    rows = [(1, i, *(rng.uniform(0, 90) for _ in "xy"), *(rng.choice([0.5, 1.0, 4.0, 16.0, 17.0, 45.0, 64.0, 120.0]) for _ in "wh")) for i in range(250)]
    told = spark.createDataFrame(rows, "package_id long, no long, x0 double, y0 double, w double, h double").selectExpr("package_id", "no", "x0", "y0", "x0 + w AS x1", "y0 + h AS y1")
    items = [{"no": r["no"], "e": (r["x0"], r["y0"], r["x1"], r["y1"])} for r in told.collect()]
    want = {(b["no"], a["no"]) for a in items for b in items if a["no"] < b["no"] and overlap(a, b) >= 0.35}
    got = [(r["no"], r["earlier"]) for r in folds.overlapping(told).collect()]
    assert len(want) > 30 and len(got) == len(set(got)) and set(got) == want


def test_a_chain_of_readings_in_many_tiles(spark):
    """Each line resembles its neighbours alone, so every second opens a cluster: the fold's longest chain."""
    n = 5_000
    told = spark.range(n).select(
        F.lit(1).cast("long").alias("package_id"), F.col("id").cast("int").alias("index"), F.lit("net weight").alias("text"), F.lit(0.9).alias("confidence"),
        F.array(*(F.array(F.lit(float(x)), F.col("id") * 50.0 + y) for x, y in ((0, 0), (100, 0), (100, 20), (0, 20)))).alias("box"), F.lit("original").alias("source"),
    )
    got = {r["index"]: r["cluster"] for r in L.reading_clusters(told, tile=1_000).collect()}
    assert got == {i: i // 2 for i in range(n)}


def test_folds_of_empty_tables_and_other_columns(spark):
    told = spark.createDataFrame([(1, 0, "a b", 0.5, box(0, 0), "original")], LINE).withColumn("adjusted_confidence", F.lit(0.5)).withColumns({"no": F.lit(9), "home": F.lit("x"), "x": F.lit("y")})
    assert [r["text"] for r in L.merge_readings(told).collect()] == ["a b"]
    assert [tuple(r) for r in L.reading_clusters(told).collect()] == [(1, 0, 0)]
    assert L.merge_readings(told.where("false")).count() == 0 and L.reading_clusters(told.where("false")).count() == 0
