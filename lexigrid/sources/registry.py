"""Experiments stored as tables and found again by name.

Every table is partitioned by experiment name.  Saving an experiment again
replaces its partition and no other; looking one up reads its partition only.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexigrid.fixed_values import CONFIG_TITLES, OVERVIEW_COLUMNS
from lexigrid.operators.naive_bayes import MultinomialNB

RECORD = (
    "project string, name string, clf string, clf_full string, features string, "
    "train_data array<string>, train_data_path array<string>, train_data_repr array<string>, "
    "test_data array<string>, test_data_path array<string>, test_data_repr array<string>, "
    "lime_data array<string>, lime_data_path array<string>, lime_data_repr array<string>, "
    "lime_data_comp array<struct<expl:array<struct<word:string,weight:double>>,prb:array<double>,cln:array<string>>>, "
    "test_score double, dur double"
)


class Registry:
    """Tables ``overview``, ``model``, ``sums``, ``results`` under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Write rows by ``name``, replacing those of the same names."""
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("name")
            .parquet(self.path(table))
        )

    def table(self, table: str) -> DataFrame:
        found = self.spark.read.parquet(self.path(table)).schema
        # names are text, also those that look like numbers or dates
        fields = [StructField("name", StringType()) if f.name == "name" else f for f in found]
        return self.spark.read.schema(StructType(fields)).parquet(self.path(table))

    def component(self, table: str, name: str) -> DataFrame:
        """The rows of one experiment."""
        return self.table(table).where(F.col("name") == name)

    def fetch(self, column: str, value, table: str = "overview") -> DataFrame:
        """The first record whose column has the value, if any."""
        return self.table(table).where(F.col(column) == value).limit(1)

    def overview(self) -> DataFrame:
        """All experiments with the columns of the result table."""
        return self.table("overview").select(*OVERVIEW_COLUMNS)

    def config_view(self, name: str | None = None) -> DataFrame:
        rows = self.table("overview")
        return config_view(rows if name is None else rows.where(F.col("name") == name))

    def save_model(self, name: str, model: MultinomialNB, features: list[str]) -> None:
        """Store a fitted model: class numbers as one row, sums as a table."""
        row = {
            "classes": model.classes, "docs": model.docs, "totals": model.totals,
            "vocabulary_size": model.vocabulary_size, "alpha": model.alpha,
        }
        meta = self.spark.createDataFrame([(name, json.dumps(row), features)], "name string, model string, features array<string>")
        self.upsert("model", meta)
        self.upsert("sums", model.sums.withColumn("name", F.lit(name)))

    def load_model(self, name: str) -> MultinomialNB:
        found = self.component("model", name).first()
        if found is None:
            raise KeyError(f"no model stored for {name!r}")
        row = json.loads(found["model"])
        return MultinomialNB(
            tuple(row["classes"]), tuple(map(tuple, row["docs"])), tuple(map(tuple, row["totals"])),
            row["vocabulary_size"], self.component("sums", name).drop("name"), row["alpha"],
        )


def config_view(records: DataFrame) -> DataFrame:
    """``name, title, value``: the settings of experiments as rows."""
    def text(column: str):
        kind = dict(records.dtypes)[column]
        return F.array_join(column, ",") if kind.startswith("array") else F.col(column).cast("string")

    pairs = [F.struct(F.lit(t).alias("title"), text(c).alias("value")) for c, t in CONFIG_TITLES]
    return records.select(F.col("name"), F.inline(F.array(*pairs)))


def records(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Experiment records as rows of the overview table."""
    schema = StructType.fromDDL(RECORD)
    filled = [tuple(r.get(f.name, "-" if f.name == "project" else None) for f in schema) for r in rows]
    return spark.createDataFrame(filled, schema)
