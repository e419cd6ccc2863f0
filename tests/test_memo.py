"""Analyses kept between runs."""

from __future__ import annotations

import uuid

from labelloom.plans.memo import AnalysisMemo, analyse_images_once, remembered

IMAGES = "package_id string, image_no int, content binary"


def test_a_second_run_reads_only_new_images(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    box = [[0.0, 0.0], [90.0, 0.0], [90.0, 20.0], [0.0, 20.0]]

    def reader(content, name):
        (seen / uuid.uuid4().hex).write_bytes(content)
        if content == b"bad":
            raise ValueError("no picture")
        return [(content.decode(), 0.9, box)] if name == "original" else []

    def contents():
        found = {f.read_bytes() for f in seen.iterdir()}
        for f in seen.iterdir():
            f.unlink()
        return found

    def told(found):
        rows = {r.package_id: r for r in found["packages"].collect()}
        prices = {r.package_id: r.mrp for r in found["declarations"].collect()}
        return {p: (r.reused, r.status, prices.get(r["first"]), len(r.errors)) for p, r in rows.items()}

    memo = AnalysisMemo(spark, f"file://{tmp_path}/memo")
    first = [("a", 0, b"MRP Rs 50.00"), ("b", 0, b"MRP Rs 50.00"), ("c", 0, b"bad"), (None, 0, b"MRP Rs 9.00")]
    names = spark.createDataFrame([(x,) for x in "abce"], "package_id string")
    found = analyse_images_once(memo, spark.createDataFrame(first, IMAGES), reader, packages=names)
    want = {"a": (False, "ok", "₹50.00", 1), "b": (False, "ok", "₹50.00", 1), "c": (False, "error", None, 1), "e": (False, "error", None, 1)}
    assert told(found) == want and contents() == {b"MRP Rs 50.00", b"bad"}
    assert found["compliance"].count() == 1 and len(memo.runs()) == 1

    second = spark.createDataFrame([("z", 0, b"MRP Rs 50.00"), ("c", 0, b"bad"), ("y", 0, b"MRP Rs 7.00")], IMAGES)
    want = {"z": (True, "ok", "₹50.00", 1), "c": (True, "error", None, 1), "y": (False, "ok", "₹7.00", 1)}
    assert told(analyse_images_once(memo, second, reader)) == want and contents() == {b"MRP Rs 7.00"}


def test_runs_broken_off_runs_at_once_and_empty_ones(spark, tmp_path):
    memo = AnalysisMemo(spark, f"file://{tmp_path}/memo", ("sizes",))
    calls = []

    def analysis(images):
        calls.append(images.count())
        return {"sizes": images.selectExpr("package_id", "coalesce(octet_length(content), 0) AS size")}

    ids, found = remembered(memo, spark.createDataFrame([], IMAGES), analysis)
    assert ids.count() == 0 and found["sizes"].count() == 0 and calls == [0]
    images = spark.createDataFrame([("a", 0, b"xy"), ("n", 0, None), ("e", 0, b"")], IMAGES)
    rows = lambda: sorted((i.package_id, s.size, i.reused) for i in ids.collect() for s in found["sizes"].collect() if s.package_id == i.signature)
    # tables without the list of signatures: a run that broke off
    images.selectExpr("'x' AS package_id", "9 AS size").write.parquet(f"file://{tmp_path}/memo/sizes/run=r0-broken")
    ids, found = remembered(memo, images, analysis)
    assert rows() == [("a", 2, False), ("e", 0, False), ("n", 0, False)] and calls == [0, 3]
    # another run stored the same signatures: each is served once
    memo.add(ids, {"sizes": found["sizes"]})
    ids, found = remembered(memo, images, analysis)
    assert rows() == [("a", 2, True), ("e", 0, True), ("n", 0, True)] and calls == [0, 3] and found["sizes"].count() == 3
    # forgotten runs are analysed anew, in whatever order they were stored
    memo.retain(0)
    assert memo.runs() == []
    ids, found = remembered(memo, images, analysis)
    assert rows() == [("a", 2, False), ("e", 0, False), ("n", 0, False)] and calls == [0, 3, 3]
