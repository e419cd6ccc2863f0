"""Packages, lines, model answers and inspections made from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import vocabulary as V
from labelloom.shipping import ship_package
from labelloom.staging import keyed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _box(left: Column, top: Column, width: Column, height: Column) -> Column:
    right, bottom = left + width, top + height
    point = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    return F.array(point(left, top), point(right, top), point(right, bottom), point(left, bottom))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents, with made-up confidences and boxes."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("package_id"), F.posexplode(F.split("text", "\n")).alias("index", "text"))
    n = F.col("package_id") * 31 + F.col("index") * 7
    box = _box((F.col("index") % 2) * 300, F.col("index") * 30, F.least(F.length("text"), F.lit(60)) * 8, 14 + (F.col("index") % 3) * 6)
    source = F.when(F.col("index") % 2 == 0, "original").otherwise("enhanced")
    return d.where(F.trim("text") != "").select("package_id", "index", "text", (n % 100 / 100).alias("confidence"), box.alias("box"), source.alias("source"))


DOC_LINES = """doc_lines AS (
  SELECT package_id, CAST(i AS INT) AS "index", text, (package_id * 31 + i * 7) % 100 / 100.0::DOUBLE AS confidence,
    CAST((i % 2) * 300 AS DOUBLE) AS x0, CAST(i * 30 AS DOUBLE) AS y0, CAST((i % 2) * 300 + least(length(text), 60) * 8 AS DOUBLE) AS x1,
    CAST(i * 30 + 14 + (i % 3) * 6 AS DOUBLE) AS y1, CASE WHEN i % 2 = 0 THEN 'original' ELSE 'enhanced' END AS source
  FROM (SELECT doc_id AS package_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)
  WHERE trim(text) <> '')"""


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One package a part, with the supplier and day of its first line item."""
    first = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(F.min(F.struct("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey"), "l_shipdate")).alias("l"))
        .select("p_partkey", "l.s_suppkey", "l.l_shipdate")
    )
    return keyed(table(spark, sf_dir, "part")).join(first, "p_partkey").join(keyed(table(spark, sf_dir, "supplier")).select("s_suppkey", "s_name"), "s_suppkey")


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is printed on each package; every line is left out on some."""
    k = F.col("p_partkey")
    day = lambda x: F.upper(F.date_format(x, "dd MMM yyyy"))
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    printed = [
        (k % 11 != 0, F.concat(F.lit("Product: "), "p_name")),
        (k % 7 != 3, F.concat(F.lit("MRP Rs "), price)),
        (k % 5 != 4, F.concat(F.lit("Net Qty: "), F.col("p_size").cast("string"), F.lit(" kg"))),
        (k % 9 != 2, F.concat(F.lit("Batch No: LOT"), k.cast("string"))),
        (k >= 0, F.concat(F.lit("Manufactured by "), "s_name", F.when(k % 3 == 0, " Foods Ltd").otherwise(" Traders Ltd"))),
        (k % 13 != 5, F.concat(F.lit("MFG Date: "), day(F.col("l_shipdate")))),
        (k % 2 == 0, F.lit("Made in India")),
        (k % 4 == 1, F.concat(F.lit("Customer Care: +91 98"), F.lpad(k.cast("string"), 8, "0"))),
        (k % 6 == 2, F.concat(F.lit("Lic No 1001"), F.lpad(k.cast("string"), 10, "0"))),
        (k % 5 == 1, F.concat(F.lit("Ingredients: "), "p_type")),
        (k % 8 == 3, F.lit("Vegetarian")),
        (k % 4 == 2, F.concat(F.lit("USE BY: "), day(F.date_add(F.col("l_shipdate").cast("date"), 365)))),
        (k % 3 == 1, F.concat(F.lit("PLOT "), F.col("s_suppkey").cast("string"), F.lit(", SECTOR 38, INDUSTRIAL AREA, DELHI 110"), F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0"))),
    ]
    lines = F.filter(F.transform(F.array(*(F.when(c, t) for c, t in printed)), lambda t, i: F.struct(i.alias("index"), t.alias("text"))), lambda x: x["text"].isNotNull())
    told = packages(spark, sf_dir).select(k.alias("package_id"), F.inline(lines))
    n = (F.col("package_id") * 7 + F.col("index") * 13) % 50
    box = _box(F.lit(0), F.col("index") * 400, F.length("text") * 8, F.lit(20))
    return told.select("package_id", "index", "text", ((n + 50) / 100).alias("confidence"), box.alias("box"), F.when(F.col("index") % 2 == 0, "original").otherwise("enhanced").alias("source"))


PACKAGES = """packages AS MATERIALIZED (
  SELECT p.*, s.s_suppkey, s.s_name, l.l_shipdate
  FROM part p
  JOIN (SELECT l_partkey, l_suppkey, l_shipdate, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate) AS r FROM lineitem) l ON l.l_partkey = p.p_partkey AND l.r = 1
  JOIN supplier s ON s.s_suppkey = l.l_suppkey)"""

LABEL_LINES = f"""{PACKAGES},
printed AS (
  SELECT p_partkey AS package_id, unnest([
    CASE WHEN p_partkey % 11 <> 0 THEN 'Product: ' || p_name END,
    CASE WHEN p_partkey % 7 <> 3 THEN 'MRP Rs ' || CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) END,
    CASE WHEN p_partkey % 5 <> 4 THEN 'Net Qty: ' || p_size || ' kg' END,
    CASE WHEN p_partkey % 9 <> 2 THEN 'Batch No: LOT' || p_partkey END,
    'Manufactured by ' || s_name || CASE WHEN p_partkey % 3 = 0 THEN ' Foods Ltd' ELSE ' Traders Ltd' END,
    CASE WHEN p_partkey % 13 <> 5 THEN 'MFG Date: ' || upper(strftime(l_shipdate, '%d %b %Y')) END,
    CASE WHEN p_partkey % 2 = 0 THEN 'Made in India' END,
    CASE WHEN p_partkey % 4 = 1 THEN 'Customer Care: +91 98' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') END,
    CASE WHEN p_partkey % 6 = 2 THEN 'Lic No 1001' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') END,
    CASE WHEN p_partkey % 5 = 1 THEN 'Ingredients: ' || p_type END,
    CASE WHEN p_partkey % 8 = 3 THEN 'Vegetarian' END,
    CASE WHEN p_partkey % 4 = 2 THEN 'USE BY: ' || upper(strftime(CAST(l_shipdate AS DATE) + 365, '%d %b %Y')) END,
    CASE WHEN p_partkey % 3 = 1 THEN 'PLOT ' || s_suppkey || ', SECTOR 38, INDUSTRIAL AREA, DELHI 110' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') END]) AS text,
    unnest(range(0, 13)) AS i FROM packages),
label_lines AS (
  SELECT package_id, CAST(i AS INT) AS "index", text, ((package_id * 7 + i * 13) % 50 + 50) / 100.0::DOUBLE AS confidence, 0.0::DOUBLE AS x0, CAST(i * 400 AS DOUBLE) AS y0,
    CAST(length(text) * 8 AS DOUBLE) AS x1, CAST(i * 400 + 20 AS DOUBLE) AS y1, CASE WHEN i % 2 = 0 THEN 'original' ELSE 'enhanced' END AS source
  FROM printed WHERE text IS NOT NULL)"""

def close_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 30 pixels apart, with the label on one and the value on the next: a kind of declaration for each package."""
    k, size = F.col("p_partkey"), F.greatest(F.col("p_size"), F.lit(1)).cast("string")
    key = k.cast("string")
    told = [
        ("Net Weight:", F.concat(size, F.lit(" kg"))), ("Batch No", F.concat(F.lit("AB"), key, F.lit("X"))), ("BEST BEFORE", F.lit("6 MONTHS")),
        ("FSSAI Lic No", F.concat(F.lit("1001"), F.lpad(key, 10, "0"))), ("Manufactured by", F.concat("s_name", F.lit(" Foods Ltd"))), ("Ingredients:", F.concat(F.lit("Sugar and Salt "), key)),
        ("PACKING DATE: 11 APR", F.lit("2026")), ("Nutritional Information", F.concat(F.lit("Energy "), key, F.lit(" kcal"))),
    ]
    texts = F.element_at(F.array(*(F.array(F.lit(a), b) for a, b in told)), (k % 8 + 1).cast("int"))
    lines = packages(spark, sf_dir).select(k.alias("package_id"), F.posexplode(texts).alias("index", "text"))
    box = _box(F.lit(0), F.col("index") * 30, F.lit(200), F.lit(20))
    return lines.select("package_id", "index", "text", (F.lit(0.9) - F.col("index") * 0.1).alias("confidence"), box.alias("box"), F.lit("original").alias("source"))


CLOSE = f"""{PACKAGES},
close AS (SELECT *, p_partkey % 8 AS kind, CASE p_partkey % 8 WHEN 0 THEN greatest(p_size, 1) || ' kg' WHEN 1 THEN 'AB' || p_partkey || 'X' WHEN 2 THEN '6 MONTHS' WHEN 3 THEN '1001' || lpad(CAST(p_partkey AS VARCHAR), 10, '0')
  WHEN 4 THEN s_name || ' Foods Ltd' WHEN 5 THEN 'Sugar and Salt ' || p_partkey WHEN 6 THEN '11 APR 2026' ELSE 'Energy ' || p_partkey || ' kcal' END AS value,
  CASE p_partkey % 8 WHEN 0 THEN 'net_quantity' WHEN 1 THEN 'batch_number' WHEN 2 THEN 'best_before' WHEN 3 THEN 'fssai_license_number' WHEN 4 THEN 'manufacturer' WHEN 5 THEN 'ingredients'
  WHEN 6 THEN 'manufacturing_date' ELSE 'nutrition' END AS field FROM packages)"""


#: Field, and the value printed for it, in terms of `packages`.
_TOLD = {
    "product_name": "CASE WHEN p_partkey % 11 <> 0 THEN p_name END",
    "mrp": "CASE WHEN p_partkey % 7 <> 3 THEN '₹' || CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) END",
    "net_quantity": "CASE WHEN p_partkey % 5 <> 4 AND p_size > 0 THEN p_size || ' kg' END",
    "batch_number": "CASE WHEN p_partkey % 9 <> 2 THEN 'LOT' || p_partkey END",
    "manufacturer": "s_name || CASE WHEN p_partkey % 3 = 0 THEN ' Foods Ltd' ELSE ' Traders Ltd' END",
    "manufacturing_date": "CASE WHEN p_partkey % 13 <> 5 THEN upper(strftime(l_shipdate, '%d %b %Y')) END",
    "country_of_origin": "CASE WHEN p_partkey % 2 = 0 THEN 'India' END",
    "consumer_care": "CASE WHEN p_partkey % 4 = 1 THEN '+91-98' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') END",
    "fssai_license_number": "CASE WHEN p_partkey % 6 = 2 THEN '1001' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') END",
    "ingredients": "CASE WHEN p_partkey % 5 = 1 THEN p_type END",
    "veg_nonveg": "CASE WHEN p_partkey % 8 = 3 THEN 'Vegetarian' END",
    "expiry_date": "CASE WHEN p_partkey % 4 = 2 THEN upper(strftime(CAST(l_shipdate AS DATE) + 365, '%d %b %Y')) END",
}
TOLD = f"""{LABEL_LINES},
told AS MATERIALIZED (
  SELECT p_partkey AS package_id, unnest([{', '.join(f"'{f}'" for f in _TOLD)}]) AS field, unnest([{', '.join(_TOLD.values())}]) AS value FROM packages),
declared AS (
  SELECT package_id, {', '.join(f"max(value) FILTER (field = '{f}') AS {f}" for f in _TOLD)}, any_value(raw) AS raw
  FROM told JOIN (SELECT package_id, string_agg(text, ' ' ORDER BY "index") AS raw FROM label_lines GROUP BY package_id) USING (package_id) GROUP BY package_id)"""


def told_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(package_id, field, value) as printed, without going through extraction."""
    k = F.col("package_id")
    x = F.regexp_extract
    t = F.col("text")
    n = F.col("index")
    field_of = {0: "product_name", 1: "mrp", 2: "net_quantity", 3: "batch_number", 4: "manufacturer", 5: "manufacturing_date", 6: "country_of_origin", 7: "consumer_care", 8: "fssai_license_number", 9: "ingredients", 10: "veg_nonveg", 11: "expiry_date"}
    name = F.element_at(F.create_map(*(F.lit(y) for p in field_of.items() for y in p)), n)
    value = (
        F.when(n == 1, F.concat(F.lit("₹"), x(t, r"Rs (.*)", 1))).when(n == 4, x(t, "by (.*)", 1)).when(n == 6, x(t, "in (.*)", 1)).when(n == 7, F.concat(F.lit("+91-"), x(t, r"\+91 (.*)", 1)))
        .when(n == 8, x(t, "No (.*)", 1)).when(n == 10, t).otherwise(x(t, ": (.*)", 1))
    )
    return label_lines(spark, sf_dir).where(n < 12).select(k, name.alias("field"), value.alias("value")).where((F.col("field") != "net_quantity") | (F.col("value") != "0 kg"))


def told_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row a package, with its lines as raw_text."""
    fields = told_fields(spark, sf_dir).groupBy("package_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in V.DECLARED_FIELDS))
    lines = label_lines(spark, sf_dir).groupBy("package_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda v: v["text"]).alias("raw_text"))
    return fields.join(lines, "package_id")


def model_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model fields for what is printed: absent, equal, equal but for marks, disjoint, unclear, or filling a gap."""
    known = told_fields(spark, sf_dir).where(F.col("field").isin("product_name", "mrp", "batch_number", "manufacturer", "net_quantity"))
    kind = F.pmod(F.col("package_id") + F.length("field"), F.lit(6))
    value = F.when(kind == 2, F.concat(F.lit("- "), "value", F.lit("!"))).when(kind == 3, F.lit("zzzz qqqq jjjj xxxx")).otherwise(F.col("value"))
    gaps = packages(spark, sf_dir).select(F.col("p_partkey").alias("package_id"), F.lit("storage_instructions").alias("field"), F.lit("Store cool").alias("value"))
    told = known.where(kind != 0).select("package_id", "field", value.alias("value"), F.when(kind == 4, "unclear").otherwise("detected").alias("status"))
    both = told.unionByName(gaps.where(F.col("package_id") % 6 == 5).withColumn("status", F.lit("detected")))
    confidence = (F.col("package_id") % 10 / 10).alias("confidence")
    return both.select("package_id", "field", "value", "status", confidence, F.array(F.lit(1), F.lit(2)).alias("evidence_ids"), F.array(F.lit("a"), F.lit("b")).alias("evidence"), F.lit("seen").alias("reason"))


MODEL_FIELDS = f"""{TOLD},
model AS (
  SELECT package_id, field, CASE kind WHEN 2 THEN '- ' || value || '!' WHEN 3 THEN 'zzzz qqqq jjjj xxxx' ELSE value END AS value,
    CASE WHEN kind = 4 THEN 'unclear' ELSE 'detected' END AS status, package_id % 10 / 10.0::DOUBLE AS confidence
  FROM (SELECT *, (package_id + length(field)) % 6 AS kind FROM told WHERE value IS NOT NULL AND field IN ('product_name', 'mrp', 'batch_number', 'manufacturer', 'net_quantity'))
  WHERE kind <> 0
  UNION ALL SELECT p_partkey, 'storage_instructions', 'Store cool', 'detected', p_partkey % 10 / 10.0::DOUBLE FROM packages WHERE p_partkey % 6 = 5)"""


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(package_id, payload): answers as JSON with every kind of fault in them."""
    k = F.col("p_partkey")
    status = F.element_at(F.array(*map(F.lit, ("detected", "DETECTED", "missing", "unclear", "sure"))), (k % 5 + 1).cast("int"))
    ids = F.when(k % 4 == 0, F.array(F.lit("1"), F.lit("1"), F.lit("99"))).when(k % 4 == 1, F.array(F.lit("2"), F.lit("x"), F.lit("1"))).otherwise(F.array().cast("array<string>"))
    value = F.when(k % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
    answer = F.struct(value.alias("value"), status.alias("status"), (k % 30 / 10 - 0.5).cast("decimal(4,1)").cast("string").alias("confidence"), ids.alias("evidence_ids"), F.lit(" read ").alias("reason"))
    payload = F.to_json(F.struct(F.struct(answer.alias("product_name")).alias("fields")))
    return packages(spark, sf_dir).select(k.alias("package_id"), payload.alias("payload"))


def inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inspection an order."""
    k = F.col("o_orderkey")
    decision = F.when(F.col("o_orderstatus") == "F", "Compliant").when(F.col("o_orderstatus") == "O", "Requires Correction").otherwise("Non-Compliant")
    percent = F.round((F.col("o_totalprice") * 100).cast("bigint") % 1000 / 10, 1)
    told = table(spark, sf_dir, "orders").select(
        (k + 1).alias("id"), F.format_string("INS-%05d", k + 1).alias("inspection_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), decision.alias("decision"),
        F.when(k % 5 != 0, F.concat(F.lit("Ring "), (k % 40).cast("string"))).alias("product_name"), F.concat(F.lit("Maker "), F.col("o_custkey").cast("string")).alias("manufacturer"),
        F.when(k % 3 != 0, F.concat(F.lit("LOT"), k.cast("string"))).alias("batch_number"), percent.alias("compliance_percent"), F.lit("").alias("notes"),
    )
    return told


INSPECTIONS = """inspections AS (
  SELECT o_orderkey + 1 AS id, printf('INS-%05d', o_orderkey + 1) AS inspection_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at,
    CASE o_orderstatus WHEN 'F' THEN 'Compliant' WHEN 'O' THEN 'Requires Correction' ELSE 'Non-Compliant' END AS decision,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'Ring ' || (o_orderkey % 40) END AS product_name, 'Maker ' || o_custkey AS manufacturer,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'LOT' || o_orderkey END AS batch_number, round(CAST(trunc(o_totalprice * 100) AS BIGINT) % 1000 / 10.0::DOUBLE, 1) AS compliance_percent, '' AS notes
  FROM orders)"""


