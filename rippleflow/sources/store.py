"""A store of builds: one folder of Parquet per table, partitioned by build and generation.

A save writes new generation folders first and adds its catalogue row last, so readers that follow
the catalogue never see half a build. Cells are counted while they are written; a table with cells
that are no numbers, an empty required table or a failing report leaves no catalogue row. A writer
may name the version it started from: the next version is claimed by creating a file that must not
exist yet, so of two writers from one version only one can publish. The newest catalogue row of a
build wins.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from rippleflow import schema
from rippleflow.operators.checks import Violation
from rippleflow.operators.quality import severity_rank
from rippleflow.session import literal_table

TABLES = {
    "coeff": schema.COEFF, "output": schema.OUTPUT, "final_demand": schema.FINAL_DEMAND,
    "institution_demand": schema.INSTITUTION_DEMAND, "satellite": schema.SATELLITE,
    "value_added": schema.OUTPUT, "ratings": schema.RATINGS, "concordance": schema.CONCORDANCE,
    "quality": schema.QUALITY,
}
REQUIRED = ("coeff", "final_demand")
META_COLUMNS = [f.name for f in schema.BUILD_META.fields]


class StaleBase(RuntimeError):
    """Another writer published a build first."""


@dataclass
class BuildStore:
    spark: SparkSession
    root: str

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, build_id: str, tables: dict[str, DataFrame], *, meta: dict | None = None,
             single_precision: bool = True, base: int | None = None) -> str:
        """Write the tables of one build and publish it; returns the new generation id.

        Cell values are stored as 32-bit floats unless ``single_precision`` is off. Ratings and
        their concordance come together or not at all. ``base`` is the version (see ``version``) that
        the save starts from; it raises ``StaleBase`` if another save was published since.
        """
        unknown = set(tables) - set(TABLES)
        if unknown:
            raise ValueError(f"unknown tables {sorted(unknown)}")
        if ("ratings" in tables) != ("concordance" in tables):
            raise ValueError("ratings and concordance must be stored together")
        missing = [t for t in REQUIRED if t not in tables]
        if missing:
            raise ValueError(f"a build needs {missing}")
        if "quality" in tables:
            failing = tables["quality"].where("severity = 'fail'").select("name").limit(5).collect()
            if failing:
                raise Violation(f"failing report of {build_id!r}: {[r['name'] for r in failing]}")
        generation = uuid.uuid4().hex
        for name, df in tables.items():
            out = df
            if single_precision and name not in ("quality", "concordance"):
                out = df.select(*[
                    F.col(c).cast("float").alias(c) if t == "double" else F.col(c)
                    for c, t in df.dtypes])
            cells = [c for c, t in out.dtypes if t in ("double", "float")] if name != "quality" else []
            seen = Observation()
            (out.observe(seen, F.count(F.lit(1)).alias("rows"), *[
                F.count_if(F.isnan(c) | F.col(c).isNull() | (F.abs(c) == float("inf"))).alias(c)
                for c in cells])
             .withColumn("build_id", F.lit(build_id)).withColumn("generation", F.lit(generation))
             .write.mode("append").partitionBy("build_id", "generation").parquet(self._path(name)))
            bad = [c for c in cells if seen.get[c]]
            if bad or name in REQUIRED and not seen.get["rows"]:
                raise Violation(f"{name} of {build_id!r}: " + (f"no numbers in {bad}" if bad else "no rows"))
        n_labels = tables["coeff"].select("j_region", "j_sector").distinct()
        worst = (
            tables["quality"].agg(F.max(severity_rank()).alias("r")).select(
                F.element_at(F.array(*[F.lit(s) for s in ("pass", "warn", "fail")]),
                             F.col("r") + 1).alias("quality_worst"))
            if "quality" in tables else
            self.spark.range(1).select(F.lit(None).cast("string").alias("quality_worst")))
        values = {
            "source": "", "source_version": "", "reference_year": None, "licence": "",
            "price_basis": "basic", "currency": "EUR", "unit": "MEUR",
            "final_demand_kind": "by_region", "aggregation": "full", "retrieved": "",
            **(meta or {}), "build_id": build_id, "generation": generation}
        row = n_labels.agg(F.count("*").alias("n_labels")).join(worst).withColumn(
            "written", F.current_timestamp())
        types = {f.name: f.dataType for f in schema.BUILD_META.fields}
        for key, value in values.items():
            row = row.withColumn(key, F.lit(value).cast(types[key]))
        self._claim(build_id, self.version(build_id) if base is None else base)
        row.select(*META_COLUMNS).write.mode("append").parquet(self._path("catalogue"))
        return generation

    def catalogue(self) -> DataFrame:
        """Newest row of every build, ordered by id; empty before the first save."""
        return latest(self._read("catalogue", schema.BUILD_META)).orderBy("build_id")

    def build_ids(self) -> list[str]:
        return [r["build_id"] for r in self.catalogue().select("build_id").collect()]

    def has(self, build_id: str) -> bool:
        return not self.catalogue().where(F.col("build_id") == build_id).isEmpty()

    def load(self, build_id: str) -> dict[str, DataFrame]:
        """All tables of a build's newest generation; optional ones are empty when absent."""
        row = self.catalogue().where(F.col("build_id") == build_id).select("generation").first()
        if row is None:
            raise FileNotFoundError(f"no build {build_id!r} in {self.root}")
        out = {}
        for name, layout in TABLES.items():
            df = self._read(name, layout)
            if "generation" in df.columns:
                # Partition columns: only this build's files are listed and read.
                df = df.where((F.col("build_id") == build_id)
                              & (F.col("generation") == row["generation"]))
            out[name] = df.select(*[
                F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
                else F.lit(None).cast(f.dataType).alias(f.name) for f in layout.fields])
        return out

    def load_quality(self, build_id: str) -> DataFrame:
        return self.load(build_id)["quality"]

    def version(self, build_id: str) -> int:
        """How many saves of a build were published."""
        folder, files = self._claims(build_id)
        return len(files.listStatus(folder)) if files.exists(folder) else 0

    def _claims(self, build_id: str):
        name = hashlib.sha256(build_id.encode()).hexdigest()
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions/{name}")
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _claim(self, build_id: str, base: int) -> None:
        folder, files = self._claims(build_id)
        files.mkdirs(folder)
        one = self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"{base + 1:08d}")
        if not files.createNewFile(one):
            raise StaleBase(f"build {build_id!r} was saved by another writer after version {base}")

    def _read(self, table: str, layout) -> DataFrame:
        """The stored table; empty if it was never written, which a required one must be."""
        try:
            return self.spark.read.parquet(self._path(table))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND" or table in REQUIRED:
                raise
            return literal_table(self.spark, [], layout)


def latest(catalogue: DataFrame) -> DataFrame:
    """One row per build: the last one written, ties broken by generation."""
    order = Window.partitionBy("build_id").orderBy(F.desc("written"), F.desc("generation"))
    return catalogue.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def axes(coeff: DataFrame) -> DataFrame:
    """(kind, label) of a build's regions and sectors, rebuilt from its cells."""
    ends = F.explode(F.array(
        F.struct(F.lit("region").alias("kind"), F.col("j_region").alias("label")),
        F.struct(F.lit("sector").alias("kind"), F.col("j_sector").alias("label")),
        F.struct(F.lit("region").alias("kind"), F.col("i_region").alias("label")),
        F.struct(F.lit("sector").alias("kind"), F.col("i_sector").alias("label"))))
    return coeff.select(ends.alias("e")).select("e.*").distinct()
