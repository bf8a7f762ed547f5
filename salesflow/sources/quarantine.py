"""Reading CSV files that hold lines which do not fit their schema: good rows typed, bad lines kept with their reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

FIELDS = "wrong number of fields"
_LINE = "_line"


def checked_csv(spark: SparkSession, path: str, schema: StructType, header: bool = True, multiline: bool = False) -> DataFrame:
    """Every record of the file: the columns of ``schema`` (null where unreadable), ``line`` and ``reasons``.

    A good record has no reasons. ``reasons`` names what is wrong: the number of fields, or each column whose text cannot
    be read as its type. ``line`` is the record as it stands in the file (for one with the right number of fields, written again
    from its fields). ``multiline`` reads quoted line breaks as part of a field; Spark then does not split a file, so
    very large ones should not be read that way.
    """
    text = StructType([StructField(f.name, StringType()) for f in schema] + [StructField(_LINE, StringType())])
    raw = spark.read.schema(text).option("columnNameOfCorruptRecord", _LINE).option("columnPruning", False).csv(
        path, header=header, mode="PERMISSIVE", multiLine=multiline, escape='"')
    typed = {f.name: F.col(f.name) if isinstance(f.dataType, StringType) else F.col(f.name).try_cast(f.dataType) for f in schema}
    broken = F.col(_LINE).isNotNull()
    unread = [F.when(~broken & F.col(f.name).isNotNull() & typed[f.name].isNull(), F.lit(f"unreadable {f.name}"))
              for f in schema if not isinstance(f.dataType, StringType)]
    reasons = F.array_compact(F.array(F.when(broken, F.lit(FIELDS)), *unread))
    line = F.coalesce(F.col(_LINE), F.to_csv(F.struct(*schema.names)))
    return raw.select(*[typed[f.name].alias(f.name) for f in schema], line.alias("line"), reasons.alias("reasons"))


def load_csv(spark: SparkSession, path: str, schema: StructType, quarantine: str, header: bool = True, multiline: bool = False) -> DataFrame:
    """The good rows of a CSV file; its bad lines are written to the ``quarantine`` folder, replacing what it held. Runs a job when called."""
    rows = checked_csv(spark, path, schema, header, multiline)
    rows.where(F.size("reasons") > 0).select("line", "reasons", F.lit(path).alias("source")).write.mode("overwrite").parquet(quarantine)
    return rows.where(F.size("reasons") == 0).select(*schema.names)


def quarantined(spark: SparkSession, quarantine: str) -> DataFrame:
    """How many lines each reason holds back (a line with several reasons counts for each): reason, n_lines."""
    lines = spark.read.parquet(quarantine)
    return lines.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_lines"))
