"""Stack plans in CSV: which file belongs to which batch, in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a full plan.
COLUMNS = ("order", "batch_id", "mount", "bortle", "telescope", "session_date", "filter", "exposure", "file_path")


def read_plan(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """(order, batch_id, file_path, exposure, ...) of a plan with or without a header line.

    Without a file_path column the first column is the file, or the second if the first is all digits. Relative
    paths start at `base`. Rows without a file are dropped; a plan without an order keeps the order of its lines.
    """
    first = spark.read.text(path).limit(1).collect()
    names = [c.strip().lower() for c in first[0][0].split(",")] if first else []
    header = "file_path" in names or "file" in names or "batch_id" in names
    rows = spark.read.option("header", header).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    rows = rows.toDF(*(c.strip().lower() for c in rows.columns)).withColumn("_line", F.monotonically_increasing_id())
    own = [c for c in rows.columns if c != "_line"]
    if "file_path" in own:
        file = F.col("file_path")
    elif "file" in own:
        file = F.col("file")
    elif len(own) > 1:
        file = F.when(F.col(own[0]).rlike("^[0-9]+$"), F.col(own[1])).otherwise(F.col(own[0]))
    elif own:
        file = F.col(own[0])
    else:
        file = F.lit(None).cast("string")
    full = F.when(file.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)") | F.lit(not base), file).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), file))
    have = lambda c: F.col(c) if c in own else F.lit(None).cast("string")
    order = F.coalesce(have("order").cast("long"), F.col("_line"))
    rest = [have(c).alias(c) for c in COLUMNS if c not in ("order", "batch_id", "file_path", "exposure")]
    plan = rows.select(order.alias("order"), F.coalesce(have("batch_id"), F.lit("")).alias("batch_id"), full.alias("file_path"), have("exposure").cast("double").alias("exposure"), have("weight").alias("weight"), *rest)
    return plan.where("file_path is not null and file_path <> ''")


def with_files(plan: DataFrame, files: DataFrame, missing_is_error: bool = False) -> DataFrame:
    """The plan's rows whose file_path is among files.path; ValueError if some are not and that is an error."""
    if missing_is_error:
        lost = [r[0] for r in plan.join(files, plan.file_path == files.path, "left_anti").select("file_path").limit(5).collect()]
        if lost:
            raise ValueError(f"missing files: {', '.join(lost)}")
    return plan.join(files, plan.file_path == files.path, "left_semi")
