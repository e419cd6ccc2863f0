"""Analyses kept between runs, by the signature of a package's images.

A run analyses what no earlier run has, one package of each set of equal images,
and serves all others from what is stored. Results stand under the signature,
so that a set of images which very many packages share is stored and read once.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.plans.package_analysis import analyse_images
from labelloom.sources.images import Answerer, Reader, signature
from labelloom.staging import stage

#: A function from images (package_id, image_no, content) to named tables with a package_id.
Analysis = Callable[[DataFrame], dict[str, DataFrame]]
ANALYSIS_TABLES = ("declarations", "fused", "compliance", "errors", "packages")


class AnalysisMemo:
    """Parquet folders, one a table and run. The list of a run's signatures is written last: a run that broke off is not seen.

    Runs at once may analyse the same images; the run of the smaller name serves them then. Null contents count as
    images without bytes. Rows with a null package_id are left out, as they name no package.
    """

    def __init__(self, spark: SparkSession, path: str, tables: tuple[str, ...] = ANALYSIS_TABLES):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables

    def known(self) -> DataFrame:
        """(signature, run): the run that serves each signature."""
        schema = "signature string, run string"
        try:
            told = self.spark.read.schema(schema).parquet(f"{self.path}/runs")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            told = self.spark.createDataFrame([], schema)
        return told.groupBy("signature").agg(F.min("run").alias("run"))

    def add(self, signatures: DataFrame, found: dict[str, DataFrame]) -> None:
        """Store tables whose package_id is the signature; signatures without rows in them are known from now on too."""
        run = f"r{time.time_ns():020d}-{uuid.uuid4().hex}"
        for name in self.tables:
            found[name].write.parquet(f"{self.path}/{name}/run={run}")
        signatures.select("signature").write.parquet(f"{self.path}/runs/run={run}")

    def table(self, name: str, signatures: DataFrame) -> DataFrame:
        """Stored rows of the signatures (signature, distinct), with the signature as package_id."""
        serving = self.known().join(signatures, "signature", "left_semi").withColumnRenamed("signature", "package_id")
        rows = self.spark.read.parquet(f"{self.path}/{name}")
        return rows.join(serving, ["package_id", "run"], "left_semi").drop("run")

    def runs(self) -> list[str]:
        """Names of finished runs, oldest first; as many as there were runs."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        return sorted(s.getPath().getName().removeprefix("run=") for s in fs.listStatus(root) if s.getPath().getName().startswith("run="))

    def retain(self, newest: int) -> None:
        """Forget all runs but the newest; what they served is analysed anew when it is asked for. Not while others read."""
        runs = self.runs()
        for run in runs[: max(0, len(runs) - newest)]:
            for part in ("runs", *self.tables):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}/run={run}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def remembered(memo: AnalysisMemo, images: DataFrame, analysis: Analysis) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(package_id, signature, reused) of every package with images, and the tables, whose package_id is the signature.

    reused: an earlier run had analysed its images. Of new images the package with the smallest id is analysed.
    Without any images the tables are empty.
    """
    images = images.where("package_id is not null")
    signed = stage(signature(images), "signatures")
    known = stage(memo.known(), "known")
    # one row a signature on either side; copies are counted away before the join
    firsts = signed.groupBy("signature").agg(F.min("package_id").alias("package_id"))
    new = stage(firsts.join(known, "signature", "left_anti"), "unseen")
    if not new.isEmpty() or not memo.runs():
        mine = images.join(new, "package_id")
        memo.add(new, analysis(mine.drop("package_id").withColumnRenamed("signature", "package_id")))
    asked = signed.select("signature").distinct()
    served = signed.join(known.select("signature", F.lit(True).alias("reused")), "signature", "left")
    return served.select("package_id", "signature", F.coalesce("reused", F.lit(False)).alias("reused")), {n: memo.table(n, asked) for n in memo.tables}


def analyse_images_once(
    memo: AnalysisMemo, images: DataFrame, reader: Reader | None, answerer: Answerer | None = None, packages: DataFrame | None = None
) -> dict[str, DataFrame]:
    """As `analyse_images`, with what earlier runs found: tables under the signature, which "packages" gives as `first`, with `reused`.

    What failed is stored as well, as the outcome of those images; `retain` lets it be tried again.
    """
    ids, found = remembered(memo, images, lambda unseen: analyse_images(unseen, reader, answerer))
    ids = (images if packages is None else packages).select("package_id").distinct().join(ids, "package_id", "left")
    status = found["packages"].select(F.col("package_id").alias("signature"), "status", "images_processed", "errors")
    told = ids.join(status, "signature", "left").select(
        "package_id", F.col("signature").alias("first"), F.coalesce("reused", F.lit(False)).alias("reused"), F.coalesce("status", F.lit("error")).alias("status"),
        F.coalesce("images_processed", F.lit(0)).alias("images_processed"), F.coalesce("errors", F.array(F.lit("No package images were supplied."))).alias("errors"),
    )
    return {**found, "packages": told}
