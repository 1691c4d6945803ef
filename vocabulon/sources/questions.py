"""Analogy questions from text: a line ``: name`` opens a category, lines of four words are questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value of one file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("line_no", "value"))


def parse(lines: DataFrame) -> DataFrame:
    """category, qno, a, b, c, d of ``lines`` (line_no, value).

    Lines before the first header and lines without exactly four words are skipped; a header that
    comes again starts its category anew.  Question files are small, so one window orders them.
    """
    order = Window.orderBy("line_no")
    text = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    head = F.when(text.startswith(":"), F.substring(text, 3, 1 << 20))
    open_ = F.last(head, ignorenulls=True).over(order)
    since = F.last(F.when(head.isNotNull(), F.col("line_no")), ignorenulls=True).over(order)
    rows = lines.withColumn("category", open_).withColumn("since", since).withColumn("head", head)
    latest = F.max("since").over(Window.partitionBy("category"))
    words = F.regexp_extract_all(F.lower("value"), F.lit(r"\S+"), 0)
    rows = rows.withColumn("latest", latest).where("category is not null and head is null and since = latest").withColumn("w", words).where(F.size("w") == 4)
    number = F.row_number().over(Window.partitionBy("category").orderBy("line_no"))
    return rows.select("category", number.cast("long").alias("qno"), *[F.col("w")[i].alias(x) for i, x in enumerate("abcd")])
