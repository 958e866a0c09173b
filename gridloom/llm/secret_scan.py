"""Secret scans with an incremental blob ledger.

A text is a blob, addressed by the SHA-256 of its bytes; a document is a path to a blob.  The
ledger is a table of (blob, rule version, spans) in a shared folder.  A scan takes the blobs
whose pair with the rules' version the ledger doesn't hold, each once however many paths lead
to it, appends what it found, and joins the findings to all paths.

Texts are combined per blob before they are shuffled, so a text that a third of all rows hold
moves once per task.  Only (path, address) pairs meet the findings, in an equi-join that Spark
splits where a key is heavy.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pack, shared_folder, unpack

#: kind, pattern, group whose length counts, least length.  The first three are the base; their
#: order is the order of kinds that start at the same place.
RULES = (
    ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
)
BASE = ("assign", "access", "hex")
#: What a text must hold, lower-cased for the first, for a rule to find anything in it.
NEEDS = {"assign": ("passw", "secret", "token", "api"), "access": ("AKIA",), "pem": ("-----BEGIN ",), "jwt": ("eyJ",), "forge": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")}
#: Changes with any rule, so that the ledger's old findings are no longer used.
VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
FOUND = "array<struct<kind:string,start:long,end:long>>"


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by the rules' order; places count code points."""
    found = []
    low = None
    for rank, (kind, pattern, group, least) in enumerate(RULES):
        if kind in NEEDS:
            if kind == "assign":
                low = text.lower()
            if not any(x in (low if kind == "assign" else text) for x in NEEDS[kind]):
                continue
        flags = re.ASCII | (re.IGNORECASE if kind == "assign" else 0)
        for m in re.compile(pattern, flags).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _scan(batches):
    import pyarrow as pa

    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        found = [
            [{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t)]
            for t in batch.column("text").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("blob"), pa.array(found, span)], names=["blob", "spans"]
        )


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None
) -> DataFrame:
    """docs without the text, with blob (the address) and spans (kind, start, end by start).

    ledger: a shared folder that holds earlier findings and gets the new ones; without it a new
    folder serves for this scan alone.  The scan is done when this returns; the result then only
    joins.  A scan cut short leaves no part of its findings, as the table's files appear when
    the write is committed.

    A null text is the empty blob, which has no spans.  Each row comes back, also repeated ones
    and those with a null id.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    packed = pack(docs, id_col, text_col).withColumn("blob", F.unhex(F.sha2("text", 256)))
    path = ledger or shared_folder(spark, "secret-ledger")
    table = spark.read.schema(f"blob binary, version string, spans {FOUND}")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    blobs = packed.where(F.length("text") > 0).select("blob", "text")
    if place.getFileSystem(conf).exists(place):
        known = table.parquet(path).where(F.col("version") == VERSION).select("blob")
        blobs = blobs.join(known, "blob", "left_anti")
    unseen = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    (
        unseen.mapInArrow(_scan, f"blob binary, spans {FOUND}")
        .withColumn("version", F.lit(VERSION))
        .select("blob", "version", "spans")
        .write.mode("append")
        .parquet(path)
    )
    found = (
        table.parquet(path)
        .where((F.col("version") == VERSION) & (F.size("spans") > 0))
        .select("blob", "spans")
    )
    paths = packed.drop("text").join(found, "blob", "left")
    none = F.array().cast(FOUND)
    return unpack(
        paths,
        docs.drop(text_col),
        text_col,
        {"blob": F.col("blob"), "spans": F.coalesce("spans", none)},
    )
