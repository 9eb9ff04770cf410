"""Small tables for the operators' tests."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def docs(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in rows], DOCS)


def read(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
