"""Operators on hand-made cases."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from labelloom.functions import text as T
from labelloom.operators import lines as L
from labelloom.operators.candidates import first_fit
from labelloom.operators.compliance import check_compliance
from labelloom.operators.fields import extract_fields
from labelloom.operators.fusion import validated
from labelloom.plans.package_analysis import analyse
from labelloom.sources.images import fingerprint, package_images, signature
from labelloom.sources.store import InspectionStore, with_numbers
from labelloom.streaming.line_files import stream_packages

LINE = "package_id bigint, index int, text string, confidence double, box array<array<double>>, source string"


def box(x: float, y: float, w: float = 100.0, h: float = 20.0) -> list[list[float]]:
    x, y = float(x), float(y)
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]


def lines(spark, *texts, step=30):
    return spark.createDataFrame([(1, n, t, 0.9, box(0, n * step), "original") for n, t in enumerate(texts)], LINE)


def value(spark, column) -> object:
    return spark.range(1).select(column.alias("x")).first()[0]


def test_values(spark):
    lit = F.lit
    assert value(spark, T.money_text(T.parsed_money(lit("1,299")))) == "₹1.30"
    assert value(spark, T.money_text(T.parsed_money(lit("0")))) is None
    assert value(spark, T.parsed_date(lit("PKD 11 apr 26"))) == "11 APR 2026"
    assert value(spark, T.parsed_date(lit("31/02/2026"))) == "31/02/2026"
    assert value(spark, T.normal_phone(lit("+91 98765 43210"))) == "+91-9876543210"
    assert value(spark, T.licence_number(lit("Lic No 10017654321098"))) == "10017654321098"
    assert value(spark, T.clean(lit(None).cast("string"))) == ""


def test_fields_of_a_package(spark):
    told = lines(spark, "Product: Black Masoor", "MRP Rs 50.00", "Net Weight:", "1kg", "Batch No: AB1234", "PACKING DATE: 11 APR", "2026", "Lic No 10017654321098")
    got = {r.field: r.value for r in extract_fields(L.prepare(told)).collect()}
    assert got["product_name"] == "Black Masoor" and got["mrp"] == "₹50.00" and got["net_quantity"] == "1 kg"
    assert got["batch_number"] == "AB1234" and got["manufacturing_date"] == "11 APR 2026" and got["fssai_license_number"] == "10017654321098"


def test_no_lines(spark):
    out = analyse(lines(spark, "x").where("false"))
    assert out["compliance"].count() == 0 and out["fused"].count() == 0


def test_neighbours_by_brute_force(spark):
    rows = [(1, n, "a", 0.9, box(37 * n % 90, 41 * n % 300) if n % 4 else None, "original") for n in range(14)]
    prepared = L.prepare(spark.createDataFrame(rows, LINE)).cache()
    at = {r.pos: (r.geo.x, r.geo.y) if r.geo and r.geo.y is not None else None for r in prepared.collect()}
    for count, gap in ((3, 80), (5, 180)):
        want = set()
        for i, p in at.items():
            found = []
            for j, q in at.items():
                if i == j:
                    continue
                if p is None or q is None:
                    found.append((float(abs(i - j)), j))
                elif abs(p[1] - q[1]) <= gap:
                    found.append((abs(q[1] - p[1]) + 0.35 * abs(q[0] - p[0]), j))
            want |= {(i, j, n + 1) for n, (_, j) in enumerate(sorted(found)[:count])}
        assert {(r.i, r.j, r["rank"]) for r in L.neighbours(prepared, count, gap).collect()} == want


def test_merged_readings(spark):
    told = [(1, 0, "BLACK", 0.9, box(0, 0), "original"), (1, 1, "BLACK MASOOR", 0.8, box(0, 0), "enhanced"), (1, 2, "BLACK", 0.7, box(1, 1), "enhanced"), (1, 3, "??", 0.9, box(0, 90), "original")]
    got = L.merge_readings(L.useful_readings(spark.createDataFrame(told, LINE)))
    assert sorted(r.text for r in got.collect()) == ["BLACK", "BLACK MASOOR"]


def test_first_fit_keeps_packages_apart(spark):
    rows = [(p, "net_quantity", [n, 0, 0], v, 1.0, 1.0, "original") for p in (1, 2) for n, v in enumerate(["1 kg", "11 kg", "500 g"])]
    got = first_fit(spark.createDataFrame(rows, "package_id long, field string, ord array<int>, value string, score double, confidence double, source string"))
    assert {(r.package_id, r.value): r.group for r in got.collect()} == {(p, v): g for p in (1, 2) for v, g in (("1 kg", 0), ("11 kg", 0), ("500 g", 1))}


def test_validation_of_answers(spark):
    dense = L.dense_lines(lines(spark, "one", "two"))
    payload = {"fields": {"mrp": {"value": "₹5", "status": "DETECTED", "confidence": 1.7, "evidence_ids": [1, 1, 9]}, "nutrition": {"value": "x", "status": "detected", "evidence_ids": []}, "ingredients": {"value": "y", "status": "sure"}}}
    got = {r.field: r for r in validated(spark.createDataFrame([(1, json.dumps(payload))], "package_id bigint, payload string"), dense).collect()}
    assert len(got) == 18 and got["mrp"].status == "detected" and got["mrp"].confidence == 1.0 and got["mrp"].evidence_ids == [1]
    assert got["nutrition"].status == "unclear" and got["ingredients"].status == "unclear" and got["product_name"].status == "missing"


def test_compliance_of_an_empty_package(spark):
    got = check_compliance(spark.createDataFrame([(1, None, [])], "package_id bigint, product_name string, raw_text array<string>")).first()
    assert (got.total_rules, got.applicable_rules, got.detected_rules, got.status) == (19, 7, 0, "review")


def test_store_never_gives_a_number_twice(spark, tmp_path):
    store = InspectionStore(spark, f"file://{tmp_path}/store")
    one = spark.createDataFrame([("Compliant", "Dal")], "decision string, product_name string")
    assert store.rows().count() == 0
    assert [store.save(one)[0] for _ in range(2)] == ["INS-00001", "INS-00002"]
    assert store.delete("INS-00002") and not store.delete("INS-00002")
    assert store.save(one) == ["INS-00003"]
    assert [r.id for r in store.list(0).collect()] == [3] and store.list(None).count() == 2


def test_all_orders_are_numbered_in_many_tasks(spark):
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderdate", "o_orderkey", "o_orderstatus").repartition(7)
    got = with_numbers(orders.withColumn("none", F.lit(None)), 7, "o_orderdate", "o_orderkey")
    assert got.columns == ["o_orderdate", "o_orderkey", "o_orderstatus", "none", "id", "inspection_id"]
    assert not [line for line in got._jdf.queryExecution().toString().splitlines() if "SinglePartition" in line or "Window" in line]
    want = sorted((r.o_orderdate, r.o_orderkey) for r in orders.collect())
    assert [(r.o_orderdate, r.o_orderkey) for r in got.orderBy("id").collect()] == want
    assert [r.id for r in got.orderBy("id").select("id").collect()] == list(range(8, len(want) + 8))
    # equal records, too, are each numbered once
    same = with_numbers(spark.range(0, 5000, 1, 5).select(F.lit("x").alias("decision")), 0, "decision")
    assert sorted(r.id for r in same.collect()) == list(range(1, 5001))
    assert with_numbers(orders.limit(0), 3, "o_orderkey").count() == 0


def test_numbering_takes_no_python_workers(spark):
    got = with_numbers(spark.range(0, 5000, 1, 5).select(F.lit("x").alias("decision")), 0, "decision")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan  # a list of rows comes as an RDD that Python workers unpickle


def test_images(spark, tmp_path):
    for package, content in (("a", b"one"), ("b", b"two")):
        (tmp_path / package).mkdir()
        (tmp_path / package / "1.png").write_bytes(content)
    found = package_images(spark, f"file://{tmp_path}")
    assert {r.package_id: r.signature for r in signature(found).collect()} == {"a": fingerprint([b"one"]), "b": fingerprint([b"two"])}


def test_stream_of_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines(spark, "MRP Rs 50.00").coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
    seen = []
    stream_packages(spark, f"file://{tmp_path}/in", lambda df, n: seen.append(df.count()), f"file://{tmp_path}/state").awaitTermination(120)
    assert sum(seen) == 1


def test_damaged_label_goes_with_its_words(spark):
    """The form holds a label that the text has not to the letter: the words that resemble it most go."""
    from labelloom.functions import similarity as S
    from labelloom.functions import text as T

    kinds = {"x": ["net weight", "manufactured by"], "y": ["best before"]}
    texts = ["Manufactured  By: Acme", "Net|Weight 5 kg", "plain text", None, "see Manufactured;by Acme Foods", "Best;before 6 months", "mnufactured by Acme"]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string").withColumn("form", T.match_form(F.col("text")))
    told = S.with_rests(S.with_labels(rows, kinds), kinds).orderBy("n").collect()
    assert [r.rest.x for r in told] == ["Acme", "5 kg", None, None, "see Acme Foods", None, "mnufactured by Acme"]
    assert [r.rest.y for r in told] == [None] * 5 + ["6 months", None]
    assert [r.label.x for r in told] == ["manufactured by", "net weight", None, None, "manufactured by", None, "manufactured by"]
    assert S.with_rests(S.with_labels(rows.limit(0), kinds), kinds).count() == 0


def test_closest_labels_by_brute_force(spark):
    """Every window against every label, without pruning; ties to the first label."""
    import random
    from difflib import SequenceMatcher

    from labelloom.functions import similarity as S
    from labelloom.functions import vocabulary as V

    rng = random.Random(7)
    every = [x for labels in V.LABELS.values() for x in labels]
    forms = {""}
    for _ in range(250):
        words = [rng.choice(every), rng.choice(["of", "12", "x"]), rng.choice(every)]
        text = "".join(rng.choice([c, c, c, c, c, c, c, c, "", c + rng.choice("aeiou 7")]) for c in " ".join(words[: rng.randrange(1, 4)]))
        forms.add(" ".join(text.split()))
    want = set()
    for f in forms:
        words = f.split()
        for kind, labels in V.LABELS.items():
            scored = []
            for no, label in enumerate(labels):
                n = len(label.split())
                runs = [" ".join(words[i : i + k]) for k in (n - 1, n, n + 1) if k for i in range(len(words) - k + 1)]
                scored += [(SequenceMatcher(None, r, label).ratio(), -no, label) for r in runs]
            if scored and max(scored)[0] >= 0.82:
                want.add((f, kind, max(scored)[2]))
    got = S.closest_labels(spark.createDataFrame([(f,) for f in sorted(forms)] * 2, "form string"), V.LABELS)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 200


def test_first_fit_by_brute_force(spark):
    import random
    from difflib import SequenceMatcher

    from labelloom.operators.candidates import first_fit

    rng = random.Random(4)
    base = ["red lentil", "black gram", "red lentils", "blck gram", "rice", "basmati rice", "red", "kidney beans"]
    rows = [(p, "x", [n, 0, 0], "".join(c for c in rng.choice(base) if rng.random() > 0.06)) for p in range(12) for n in range(9)]
    cands = spark.createDataFrame(rows, "package_id long, field string, ord array<int>, value string").where("trim(value) <> ''")
    got = {(r.package_id, r.no): r["group"] for r in first_fit(cands).collect()}
    for p in range(12):
        firsts: list[str] = []
        for n, v in enumerate((" ".join(v.split()) for q, _, _, v in rows if q == p and v.strip()), 1):
            for g, f in enumerate(firsts):
                a, b = set(v.split()), set(f.split())
                x, y = v.replace(" ", ""), f.replace(" ", "")
                if len(a & b) / max(len(a), len(b)) >= 0.78 or x in y or y in x or SequenceMatcher(None, v, f).ratio() >= 0.78:
                    break
            else:
                g = len(firsts)
                firsts.append(v)
            assert got[p, n] == g, (p, n, v)


def test_images_to_verdicts(spark):
    """Every package is told of: one that reads, its copy, one whose images fail, and one without images."""
    from labelloom.plans.package_analysis import analyse_images

    box = [[0.0, 0.0], [90.0, 0.0], [90.0, 20.0], [0.0, 20.0]]

    def reader(content, name):
        if content == b"bad":
            raise ValueError("no picture")
        if content == b"blank":
            return []
        return [(content.decode(), 0.9, box)] if name == "original" else []

    def answerer(prompt, images):
        assert all(u.startswith("data:image/jpeg;base64,") for u in images) and len(images) == prompt.count("MRP")
        if "7.00" in prompt:
            raise TimeoutError("too slow")
        return "{}"

    images = spark.createDataFrame(
        [("a", 0, b"MRP Rs 50.00"), ("b", 0, b"MRP Rs 50.00"), ("c", 0, b"bad"), ("d", 0, b"bad"), ("d", 1, b"MRP Rs 7.00"), ("f", 0, b"blank")], "package_id string, image_no int, content binary"
    )
    packages = spark.createDataFrame([(x,) for x in "abcdef"], "package_id string")
    # d has two images, of which one reads
    found = analyse_images(images, reader, lambda p, u: answerer(p, u[:1]), packages)
    told = {r.package_id: (r["first"], r.status, r.images_processed, len(r.errors)) for r in found["packages"].collect()}
    assert told == {"a": ("a", "ok", 1, 0), "b": ("a", "ok", 1, 0), "c": ("c", "error", 0, 1), "d": ("d", "ok", 1, 2), "e": ("e", "error", 0, 1), "f": ("f", "ok", 1, 0)}
    errors = {r.package_id: r.errors for r in found["packages"].collect()}
    assert errors["d"][1] == "AI semantic extraction failed: TimeoutError: too slow" and errors["e"] == ["No package images were supplied."]
    assert {r.package_id: r.mrp for r in found["declarations"].collect()} == {"a": "₹50.00", "d": "₹7.00", "f": None}
    assert {r.package_id: r.total_rules for r in found["compliance"].collect()} == {"a": 19, "d": 19, "f": 19}
    assert {(r.package_id, r.error) for r in found["errors"].collect()} == {("d", "TimeoutError: too slow")}


def test_neighbours_with_and_without_boxes_by_brute_force(spark):
    import random

    from labelloom.operators.lines import neighbours

    rng = random.Random(3)
    rows = [(p, n, (rng.randrange(900), rng.randrange(4000)) if rng.random() < share else None) for p, share in ((1, 0.0), (2, 0.5), (3, 0.9), (4, 1.0), (5, 0.03)) for n in range(60)]
    table = spark.createDataFrame([(p, n, None if g is None else (float(g[0]), float(g[1]))) for p, n, g in rows], "package_id int, pos int, geo struct<x: double, y: double>")
    got = {(r.package_id, r.i, r["rank"]): (r.j, round(r.distance, 6)) for r in neighbours(table, 5, 180.0).collect()}
    want = {}
    for p, i, g in rows:
        near = []
        for q, j, h in rows:
            if p == q and i != j:
                if g is None or h is None:
                    near.append((float(abs(i - j)), j))
                elif abs(g[1] - h[1]) <= 180:
                    near.append((abs(g[1] - h[1]) + 0.35 * abs(g[0] - h[0]), j))
        want |= {(p, i, k): (j, round(d, 6)) for k, (d, j) in enumerate(sorted(near)[:5], 1)}
    assert got == want


def test_neighbours_of_many_lines_without_boxes(spark):
    from labelloom.operators.lines import ranked_neighbours

    many = spark.range(100_000).select(F.lit(1).alias("package_id"), F.col("id").cast("int").alias("pos"), F.lit(None).cast("struct<x: double, y: double>").alias("geo"))
    assert ranked_neighbours(many, (80.0, 180.0)).count() <= 16 * 100_000


def test_lines_of_mixed_form(spark):
    corners = [[0, 0], [9, 0], [9, 5], [0, 5]]
    boxed = [[float(x), float(y)] for x, y in corners]
    cases = [
        (json.dumps({"text": "a \"q\" \\ ₹5", "confidence": 0.5, "bbox": corners, "source": "original", "extra": [1]}), ('a "q" \\ ₹5', 0.5, boxed, "original")),
        (json.dumps({"text": 12.5, "confidence": "0.25", "variant": "enhanced"}), ("12.5", 0.25, None, "enhanced")),
        (json.dumps({"text": None, "confidence": "high", "bbox": [[1, 2], [3, 4]]}), (None, 0.0, None, "unknown")),
        (json.dumps({"confidence": True, "bbox": "nowhere", "source": None, "variant": "v"}), (None, 1.0, None, "v")),
        ("{}", (None, 0.0, None, "unknown")),
        (json.dumps([corners, "MRP, [x]", 0.9]), ("MRP, [x]", 0.9, boxed, "unknown")),
        (json.dumps([None, "no box", None, "more"]), ("no box", 0.0, None, "unknown")),
        (json.dumps([[[1, 2], [3, None], [5, 6], [7, 8]], "hole", 7]), ("hole", 7.0, None, "unknown")),
        (json.dumps(["a", "b"]), ('["a", "b"]', 0.0, None, "unknown")),
        (json.dumps("just [text]"), ("just [text]", 0.0, None, "unknown")),
        ("42", ("42", 0.0, None, "unknown")),
        ("not JSON at all", ("not JSON at all", 0.0, None, "unknown")),
        ('{"text": broken', ('{"text": broken', 0.0, None, "unknown")),
        ("", ("", 0.0, None, "unknown")),
        ("null", (None, 0.0, None, "unknown")),
        (None, (None, 0.0, None, "unknown")),
        (json.dumps([corners, "long " * 50_000, 1]), ("long " * 50_000, 1.0, boxed, "unknown")),
    ]
    raw = spark.createDataFrame([(1, n, c) for n, (c, _) in enumerate(cases)], "package_id bigint, index int, line string")
    got = {r["index"]: (r.text, r.confidence, r.box, r.source) for r in L.adapt(raw).collect()}
    assert {n: got[n] for n in got if got[n] != cases[n][1]} == {}
    # blank ones go, the others keep their index
    kept = [r["index"] for r in L.prepare(L.adapt(raw)).orderBy("pos").collect()]
    assert kept == [n for n, (_, want) in enumerate(cases) if want[0]]
    assert L.adapt(raw.limit(0)).count() == 0


def test_faulty_answers_are_errors_of_their_package(spark):
    from labelloom.operators.fusion import answer_schema
    from labelloom.sources.images import answers

    field = {"value": "Tea", "status": "detected", "confidence": 0.9, "evidence_ids": [1], "reason": "read"}
    good = json.dumps({"fields": {"product_name": field}})
    told = ["", "no JSON", "[1]", '{"fields": [1]}', "{}", good]

    def answerer(prompt, urls):
        return None if prompt == "none" else told[int(prompt)]

    prompts = spark.createDataFrame([(n, str(n)) for n in range(len(told))] + [(99, "none")], "package_id int, prompt string")
    got = {r.package_id: r for r in answers(prompts, answerer).collect()}
    assert {p: r.payload for p, r in got.items()} == {**dict.fromkeys([0, 1, 2, 3, 4, 99], "{}"), 5: good}
    assert {p for p, r in got.items() if r.error} == {0, 1, 2, 3, 99} and got[1].error.startswith("JSONDecodeError") and "empty" in got[99].error
    dense = spark.createDataFrame([(p, 1, "Tea") for p in got], "package_id int, id int, text string")
    checked = validated(spark.createDataFrame([(p, r.payload) for p, r in got.items()], "package_id int, payload string"), dense)
    assert {r.package_id for r in checked.where("status = 'detected'").collect()} == {5} and checked.count() == 18 * len(got)
    schema = answer_schema()["properties"]["fields"]
    assert len(schema["required"]) == 18 and set(schema["properties"]["mrp"]["required"]) == set(field)
