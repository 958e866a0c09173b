"""What the operators of this subpackage share.

Rules that hold for each of them:

* A null text counts as the empty text.  A null id is ordered after all others (it is
  held as the largest 64-bit integer meanwhile) and comes back as null.
* The input's columns travel in one struct, so that a column of any name, the names
  used inside an operator included, passes through untouched.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that part words and are stripped from lines.
WS = " \t\n\x0b\x0c\r"
#: The same as a pattern, for Java and Python alike.
GAP = r"[\x20\x09-\x0D]+"
#: Stands for a null id.
NO_ID = 2**63 - 1
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns id (long, never null), text (never null) and row (all other columns and the id)."""
    rest = [F.col(name(c)) for c in docs.columns if c != text_col]
    return docs.select(
        F.coalesce(F.col(name(id_col)).cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(name(text_col)), F.lit("")).alias("text"),
        F.struct(*rest).alias("row"),
    )


def unpack(packed: DataFrame, docs: DataFrame, text_col: str, new: dict[str, Column]) -> DataFrame:
    """The columns of docs, then those of new; one of new stands in for a column of the same name."""

    def old(c: str) -> Column:
        if c in new:
            return new[c].alias(c)
        return (F.col("text") if c == text_col else F.col(f"row.{name(c)}")).alias(c)

    more = [v.alias(k) for k, v in new.items() if k not in docs.columns]
    return packed.select(*map(old, docs.columns), *more)


def ascii_lower(c: Column) -> Column:
    """A-Z become a-z; other letters stay as they are."""
    return F.translate(c, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text: the runs between characters of WS."""
    return F.filter(F.split(text, GAP), lambda w: w != F.lit(""))


def let(value: Column, body) -> Column:
    """body(value), where value is computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's path below spark.checkpoint.dir; the folder goes when the driver ends.

    Where the setting is absent, a local session gets a local folder; a cluster must have it set,
    as its machines can't read each other's folders.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        top = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", top)
        spark.sparkContext.setCheckpointDir(top)
    path = f"{top.rstrip('/')}/gridloom-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and safe from lost executors."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, table_name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table_name}.parquet")
