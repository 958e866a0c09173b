"""Line dedup: explode normalised lines, hash them, count distinct documents per hash,
drop the lines over the threshold and reassemble by position.  Native: no Python runs on
the executors.

Only line hashes, ids and positions are shuffled for counting.  The text moves once, when
the positions to drop come back to their document; where those are few, Spark sends them
to the documents instead.  A line that a large part of all documents share is counted per
document first and then combined before the shuffle.  Common lines become a table in the shared
folder, so that the way back to the documents is a plain equi-join of two inputs, which Spark
splits where one line is heavy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, ascii_lower, let, pack, unpack, written


def _line_rows(packed: DataFrame, min_chars: int) -> DataFrame:
    key = lambda line: ascii_lower(F.btrim(line, F.lit(WS)))
    hashed = F.transform(
        F.split("text", "\n", -1),
        lambda line: let(
            key(line),
            lambda k: F.when(
                F.length(k) >= min_chars,
                # two chained 64-bit hashes: 128 bits, so that no two lines of a corpus are confused
                F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), F.reverse(k)).alias("b")),
            ),
        ),
    )
    return (
        packed.select("id", "text_key", F.posexplode(hashed).alias("pos", "h"))
        .where("h is not null")
        .select("id", "text_key", "pos", "h.a", "h.b")
    )


def _kept(lines: Column, dropped: Column) -> Column:
    """The lines joined again without those at the dropped positions."""
    both = F.struct(lines.alias("l"), dropped.alias("d"))

    def rejoin(x: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(x["l"]) - 1), x["d"])
        return F.array_join(F.transform(stay, lambda i: F.get(x["l"], i)), "\n")

    return F.when(F.size(dropped) == 0, F.col("text")).otherwise(let(both, rejoin))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    max_docs: int = 1,
) -> DataFrame:
    """docs with the text left, n_lines and n_dropped.

    A text is split at newlines.  A line's key is the line without white space at both ends
    and with A-Z lower-cased.  A key of min_chars code points or more that more than max_docs
    documents hold loses its lines in all documents but the one with the smallest id, which
    keeps all of them.

    A null or empty text is one empty line and stays.  Rows with the same id are one document
    when documents are counted; each comes back, repeated rows included.  A null id comes
    after all other ids.  An empty table gives an empty table.
    """
    packed = pack(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    rows = _line_rows(packed, min_chars)
    common = written(
        rows.groupBy("a", "b", "id")
        .agg(F.lit(1).alias("one"))
        .groupBy("a", "b")
        .agg(F.count("*").alias("n_docs"), F.min("id").alias("keeper"))
        .where(F.col("n_docs") > max_docs)
        .select("a", "b", "keeper"),
        "common-lines",
    )
    dropped = (
        rows.join(common, ["a", "b"])
        .where(F.col("id") > F.col("keeper"))
        .select("id", "text_key", "pos")
        .groupBy("id", "text_key")
        .agg(F.collect_set("pos").alias("gone"))
    )
    none = F.array().cast("array<int>")
    joined = packed.join(dropped, ["id", "text_key"], "left").withColumn(
        "gone", F.coalesce("gone", none)
    )
    lines = F.split("text", "\n", -1)
    return unpack(
        joined,
        docs,
        text_col,
        {
            text_col: _kept(lines, F.col("gone")),
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": F.size("gone").cast("long"),
        },
    )
