"""Result files, samples and load statistics."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_json(df: DataFrame, path: str) -> None:
    """A result table as JSON lines, one file per partition."""
    df.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S3: an earlier result; a missing folder gives an empty table of the same schema."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _canonical(field: T.StructField) -> Column:
    """A value as text that does not depend on how an engine prints doubles: millionths for those."""
    c = F.col(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        c = F.rint(c.cast("double") * 1_000_000.0).cast("long")
    return F.coalesce(c.cast("string"), F.lit("null"))


def sample_rows(df: DataFrame, n: int = 5000, seed: int = 42) -> DataFrame:
    """Exactly n random rows (all rows if there are fewer).

    The sample is the n smallest MD5 digests of the seed with the row's values, so it depends on the rows only
    and not on where they lie; equal rows are told apart by nothing, and any of them stands for the others.
    Each task keeps its n smallest, so only n rows per task are merged.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[_canonical(f) for f in df.schema]))
    return df.withColumn("_key", key).orderBy("_key").limit(n).drop("_key")


FIXED_BYTES = {"long": 8, "bigint": 8, "double": 8, "int": 4, "float": 4, "date": 4, "smallint": 2, "tinyint": 1, "boolean": 1}


def _size(field: T.StructField) -> Column:
    """Bytes of a value: those of its UTF-8 text, or its type's width; nothing for NULL."""
    kind = field.dataType.simpleString()
    whole = F.lit(FIXED_BYTES[kind]) if kind in FIXED_BYTES else F.octet_length(F.col(field.name).cast("string"))
    return F.when(F.col(field.name).isNotNull(), whole).otherwise(0).cast("long")


def _measures(df: DataFrame) -> list[Column]:
    bytes_ = sum((_size(f) for f in df.schema), F.lit(0).cast("long"))
    return [F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
            F.coalesce(F.sum(bytes_), F.lit(0)).alias("data_bytes")]


def run_stats(df: DataFrame) -> DataFrame:
    """Rows, columns and bytes of values, as one aggregate that runs when it is asked for."""
    return df.agg(*_measures(df))


class Load:
    """S5 beside a load: the same figures, and its seconds, collected while the rows are written or counted.

        load = Load(fact)
        write_fact(load.rows, path)
        load.stats()      # n_rows, n_columns, data_bytes, seconds
    """

    def __init__(self, df: DataFrame):
        self._observation = Observation()
        self.rows = df.observe(self._observation, *_measures(df))
        self._start = time.perf_counter()

    def stats(self) -> dict[str, float]:
        """Waits for the first action on `rows`; starts none."""
        return {**self._observation.get, "seconds": time.perf_counter() - self._start}
