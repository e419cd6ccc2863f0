"""The inspection store: Parquet folders that are appended to.

Rows are never changed in place. A deletion adds a tombstone, so numbers are
never given twice: the next one follows the highest ever given, which the rows
on disk tell, deleted ones included.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.staging import stage

SCHEMA = (
    "id bigint, inspection_id string, created_at string, decision string, notes string, product_name string, mrp string, net_quantity string, batch_number string, "
    "manufacturer string, consumer_care string, country_of_origin string, manufacturing_date string, expiry_date string, compliance_percent double, applicable_rules int, "
    "detected_rules int, missing_rules int, unclear_rules int, evidence_images int, review_status_json string, record_json string"
)
DEFAULT_LIMIT = 200


def inspection_id(number: Column) -> Column:
    return F.format_string("INS-%05d", number)


def with_numbers(records: DataFrame, above: int, *order: str) -> DataFrame:
    """Numbers after `above` in the given order, for any number of records; equal ones come in any order.

    Records go by ranges of the order to tasks that count their own, and the counts of the ranges before are added. A
    record's place is written down, as another run may cut the ranges elsewhere.
    """
    spark = records.sparkSession
    void = [f.name for f in records.schema if f.dataType.typeName() == "void"]  # not for Parquet
    apart = records.drop(*void).withColumn("_tie", F.monotonically_increasing_id())
    placed = apart.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").withColumn("_place", F.monotonically_increasing_id())
    # a place is the range's number in the upper bits and the record's, from 0, in the lower 33
    within = F.col("_place").bitwiseAND((1 << 33) - 1)
    placed = stage(placed.drop("_tie").withColumn("_range", F.shiftright("_place", 33)).withColumn("_place", within), "numbered")
    parts, starts, start = [], [], above
    for part, n in sorted(placed.groupBy("_range").agg(F.max("_place") + 1).collect()):
        parts.append(part)
        starts.append(start + 1)
        start += n
    # one row a range, as many as tasks; from Arrow, as a list of rows would take Python workers of its own on every executor
    first = F.broadcast(spark.createDataFrame(pa.table({"_range": pa.array(parts, pa.int64()), "_first": pa.array(starts, pa.int64())})))
    numbered = placed.join(first, "_range").withColumn("id", F.col("_first") + F.col("_place"))
    numbered = numbered.select(*(F.lit(None).alias(c) if c in void else F.col(c) for c in records.columns), "id")
    return numbered.withColumn("inspection_id", inspection_id(F.col("id")))


def newest(inspections: DataFrame, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Newest first; a limit below 1 counts as 1, none as all."""
    ordered = inspections.orderBy(F.desc("id"))
    return ordered if limit is None else ordered.limit(max(1, int(limit)))


def decoded(inspections: DataFrame, schema: str) -> DataFrame:
    """Rows with their JSON record as the struct `record`; what the row itself says goes over it, summaries only fill gaps."""
    r = F.from_json("record_json", schema)
    told = inspections.withColumn("record", r)
    names = set(told.schema["record"].dataType.names)
    record = F.col("record")
    for c in ("inspection_id", "created_at", "decision", "notes"):
        record = record.withField(c, F.col(c))
    for c in ("compliance_percent", "product_name", "manufacturer"):
        record = record.withField(c, F.coalesce(F.col(f"record.{c}"), F.col(c)) if c in names else F.col(c))
    return told.withColumn("record", record)


def save_records(declared: DataFrame, findings: DataFrame) -> DataFrame:
    """The fifteen summary values to save of each package, counts made anew from its findings.

    declared has the fields and `evidence_images`; findings (package_id, status). Without applicable rules the percent is 100.
    """
    applies = F.col("status") != "not_applicable"
    counts = findings.groupBy("package_id").agg(
        F.count_if(applies).cast("int").alias("applicable_rules"), *(F.count_if(F.col("status") == s).cast("int").alias(f"{s}_rules") for s in ("detected", "missing", "unclear"))
    )
    names = ("product_name", "manufacturer", "manufacturer_address", "batch_number", "mrp", "net_quantity", "fssai_license_number", "manufacturing_date", "expiry_date")
    told = declared.select("package_id", *names, F.coalesce("evidence_images", F.lit(0)).alias("evidence_images")).join(counts, "package_id", "left").na.fill(0)
    percent = F.round(F.try_divide(F.col("detected_rules") * 100.0, F.col("applicable_rules")), 1)
    return told.withColumn("compliance_percent", F.coalesce(percent, F.lit(100.0)))


class InspectionStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, part: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        gone = self._read("deleted", "inspection_id string")
        return self._read("rows", SCHEMA).join(gone, "inspection_id", "left_anti").select(*[c.split()[0] for c in SCHEMA.split(", ")])

    def append(self, records: DataFrame, *order: str) -> DataFrame:
        """Append records (columns of SCHEMA without the numbers; others go into the JSON record): (id, inspection_id) of the new ones.

        One writer at a time: numbers follow the highest that is there.
        """
        last = self._read("rows", SCHEMA).agg(F.max("id")).first()[0] or 0
        told = with_numbers(records, last, *(order or records.columns[:1]))
        if "created_at" not in told.columns:
            told = told.withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
        told = told.withColumn("record_json", F.to_json(F.struct(*[c for c in told.columns if c not in ("id", "record_json")])))
        names = [c.split() for c in SCHEMA.split(", ")]
        told = told.select(*((F.col(n) if n in told.columns else F.lit(None)).cast(t).alias(n) for n, t in names))
        told.write.mode("append").parquet(f"{self.path}/rows")
        return self._read("rows", SCHEMA).where(F.col("id") > last).select("id", "inspection_id")

    def save(self, records: DataFrame, *order: str) -> list[str]:
        """`append` for a few records, whose ids are returned in order."""
        return [r.inspection_id for r in self.append(records, *order).orderBy("id").collect()]

    def list(self, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
        return newest(self.rows(), limit)

    def get(self, id_: str | None) -> DataFrame:
        return self.rows().where(F.col("inspection_id") == id_) if id_ else self.rows().limit(0)

    def delete(self, id_: str) -> bool:
        if self.get(id_).isEmpty():
            return False
        self.delete_all(self.spark.createDataFrame([(id_,)], "inspection_id string"))
        return True

    def delete_all(self, ids: DataFrame) -> None:
        """Tombstones for all of the inspection_id."""
        ids.select("inspection_id").write.mode("append").parquet(f"{self.path}/deleted")
