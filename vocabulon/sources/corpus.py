"""Reading corpora: tables with a text column, plain text files, zipped text."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text of whole text files, zipped ones too; ids follow the paths' order.  A path without files is an error.

    Paths alone are ordered, one row a file, and ids join back to the texts.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def unpack(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                if p.endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows += [(f"{p}!{n}", z.read(n).decode()) for n in sorted(z.namelist())]
                else:
                    rows.append((p, bytes(content).decode()))
            yield pd.DataFrame(rows, columns=["path", "text"])

    from pyspark.sql import Window

    texts = files.mapInPandas(unpack, "path string, text string")
    ids = texts.select("path").select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("doc_id"))
    return texts.join(ids, "path").select("doc_id", "text")


#: All white space: ASCII's, the separators 1C to 1F, and what is beyond ASCII.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def words_of(text: Column) -> Column:
    """The white-space words of a text, in order.

    All white space becomes plain blanks first, and the text is cut at single ones: half the time that one pattern of all ranges takes.
    """
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def tokens(docs: DataFrame, lower: bool = True) -> DataFrame:
    """doc_id, pos, word: white-space words in order."""
    return docs.select("doc_id", F.posexplode(words_of(F.lower("text") if lower else F.col("text"))).alias("pos", "word"))


def fetched(spark: SparkSession, url: str, path: str) -> str:
    """``path``, fetched from ``url`` if nothing is there yet; raises where that fails, so no later step runs on nothing.

    Files land by Hadoop's file systems, the shared one by default, not in the driver's own folder.
    """
    import urllib.request

    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(where):
        return path
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + ".part")
    try:
        with urllib.request.urlopen(url) as source:  # noqa: S310
            out = system.create(part, True)
            while block := source.read(1 << 20):
                out.write(bytearray(block))
            out.close()
    except OSError as failed:
        system.delete(part, False)
        raise FileNotFoundError(f"{path} is missing and {url} can't be fetched") from failed
    system.rename(part, where)
    return path
