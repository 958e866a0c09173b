"""Mixing sources to target weights by a low-discrepancy schedule.

A source's documents stand in a shuffled order, end to end; the mix reads this stream, from its
start again when it ends, in blocks of equal numbers of words.  The schedule deals slots to
sources: the point of slot k is k times the golden ratio, modulo one, and falls into one of
consecutive stretches as long as the sources' shares.  The r-th slot of a source is joined to
its r-th block.  So every run of slots is near the target shares, and the same input always
gives the same mix.

Places within a source are two prefix sums, over parts of a source and within a part, so that
no task holds a source; slots are ranked the same way, within stretches of slots and over them.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pack, unpack, written

#: 2 ** 64 divided by the golden ratio, odd.
GOLDEN = 0x9E3779B97F4A7C15
#: Slots that are ranked at once, and documents of one part of a source.
STRETCH, PART = 1 << 16, 2_000


@dataclass(frozen=True)
class Mix:
    #: A row for each document: its columns without the text (row), id, text_key, size, its
    #: source's number (src), size (source_size), target and words to take (want), and the
    #: place of its first word in its source's stream (place).
    placed: DataFrame
    #: slot, src, rank: the schedule.
    slots: DataFrame
    #: slot, src, place, epoch, first, words: the words of a document that a slot takes.
    pieces: DataFrame


def shares(sizes: list[int], weights: list[int], most: int) -> list[Fraction]:
    """Parts of all words by weight, at most `most` times a source's size; what is over goes to
    the others by their weights, until none is above."""
    out = [Fraction(0)] * len(sizes)
    left, open_ = Fraction(sum(sizes)), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] > most * sizes[i] * total]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _deal(edges: list[int], n: int):
    """Rows (stretch, slot, src, at): at counts the earlier slots of the source in the stretch."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bounds = np.array(edges, np.uint64)
        for batch in batches:
            for part in batch.column("id").to_pylist():
                slots = np.arange(part * STRETCH, min(n, (part + 1) * STRETCH), dtype=np.int64)
                points = slots.astype(np.uint64) * np.uint64(GOLDEN)
                src = np.searchsorted(bounds, points, side="right")
                order = np.argsort(src, kind="stable")
                ranked = src[order]
                starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
                at = np.empty(len(slots), np.int64)
                at[order] = np.arange(len(slots)) - np.repeat(starts, np.diff(np.append(starts, len(slots))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slots), part, np.int64)), pa.array(slots), pa.array(src.astype(np.int32)), pa.array(at)],
                    names=["stretch", "slot", "src", "at"],
                )

    return run


def schedule(spark, wanted: list[int]) -> DataFrame:
    """(slot, src, rank) with ranks 0 to wanted[src] - 1 for each source, each once.

    Slots over a source's number are left out; the few that golden-ratio points leave short, a
    number that grows with the logarithm of all slots, follow at the end, a source at a time.
    """
    n = sum(wanted)
    edges, upto = [], 0
    for w in wanted[:-1]:
        upto += w
        edges.append(min(2**64 - 1, (upto << 64) // max(n, 1)))
    stretches = -(-n // STRETCH)
    tasks = max(1, min(stretches, spark.sparkContext.defaultParallelism * 4))
    dealt = spark.range(0, stretches, 1, tasks).mapInArrow(
        _deal(edges, n), "stretch long, slot long, src int, at long"
    )
    counts = dealt.groupBy("src", "stretch").agg(F.count("*").alias("n"))
    counts = written(counts, "mix-counts")
    earlier = Window.partitionBy("src").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    quota = spark.createDataFrame([(i, w) for i, w in enumerate(wanted)], "src int, wanted long")
    # Spark takes a range for small whatever its rows are made into, so the joins say that they shuffle
    ranked = (
        dealt.hint("merge")
        .join(before.select("src", "stretch", "before"), ["src", "stretch"])
        .withColumn("rank", F.col("before") + F.col("at"))
        .join(F.broadcast(quota), "src")  # a row for each source
        .where("rank < wanted")
        .select("slot", "src", "rank")
    )
    got = counts.groupBy("src").agg(F.sum("n").alias("got"))
    short = quota.join(got, "src", "left").select("src", "wanted", F.coalesce("got", F.lit(0)).alias("got"))
    rest = (
        short.where("got < wanted")
        .select("src", "got", F.explode(F.sequence("got", F.col("wanted") - 1)).alias("rank"))
        .select((F.lit(n) + (F.col("rank") - F.col("got")) * len(wanted) + F.col("src")).alias("slot"), "src", "rank")
    )
    return ranked.union(rest)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
    block: int = 512,
    seed: int = 7,
) -> Mix:
    """The mix of docs.

    A size is a number of words.  Sources in the order of their code points, null last, have the
    weights in turn.  Their targets share 100 % of all words, but a source gives its words at
    most `most` times; what is over is shared by weight among the others.  The mix takes the
    target, rounded, from each source, so a document at most `most` times.

    A null text has no words.  A text without words is placed and never taken.  Rows of the same
    id are documents of their own; where the text is the same too, the other columns break ties, and
    rows that are copies in every column share what the mix takes of them in any order.  A null id
    comes after the others on ties of the shuffle.  An empty table gives an empty mix.  The driver holds one row for each source.
    """
    spark = docs.sparkSession
    packed = pack(docs, id_col, text_col)
    key = source_col.replace("`", "``")
    sized = written(
        packed.select(
            "row",
            "id",
            F.xxhash64("text").alias("text_key"),
            F.col(f"row.`{key}`").cast("string").alias("source_key"),
            F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
            F.xxhash64(F.to_json("row")).alias("rest_key"),
        ).withColumn("turn", F.xxhash64(F.lit(seed), "id", "text_key")),
        "mix-sizes",
    )
    totals = sized.groupBy("source_key").agg(F.count("*").alias("docs"), F.sum("size").alias("size")).collect()
    totals.sort(key=lambda r: (r.source_key is None, r.source_key or ""))
    targets = shares([r.size for r in totals], [weights[i % len(weights)] for i in range(len(totals))], most)
    wants = [min(round(t), most * r.size) for t, r in zip(targets, totals, strict=True)]
    sources = spark.createDataFrame(
        [
            (r.source_key, i, r.size, float(t), w, max(1, r.docs // PART))
            for i, (r, t, w) in enumerate(zip(totals, targets, wants, strict=True))
        ],
        "s_key string, src int, source_size long, target double, want long, parts int",
    )
    known = sized.join(sources, F.col("source_key").eqNullSafe(F.col("s_key"))).withColumn(
        "part", F.pmod(F.col("turn"), F.col("parts").cast("long"))
    )
    within = Window.partitionBy("src", "part").orderBy("turn", "id", "size", "rest_key")
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    parts = known.groupBy("src", "part").agg(F.sum("size").alias("part_size"))
    over = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("part_size").over(over), F.lit(0)))
    placed = written(
        known.withColumn("inner", F.coalesce(F.sum("size").over(upto), F.lit(0)))
        .join(parts.select("src", "part", "start"), ["src", "part"])
        .select("row", "id", "text_key", "size", "src", "source_size", "target", "want", (F.col("start") + F.col("inner")).alias("place")),
        "mix-places",
    )
    slots = schedule(spark, [-(-w // block) for w in wants]) if totals else spark.createDataFrame([], "slot long, src int, rank long")
    epochs = F.explode(F.sequence(F.lit(0), F.lit(most))).alias("epoch")
    first = F.col("epoch") * F.col("source_size") + F.col("place")
    pieces = (
        placed.where("size > 0")
        .select("src", "place", "size", "source_size", "want", epochs)
        .withColumn("a", first)
        .withColumn("b", F.least(F.col("a") + F.col("size"), F.col("want")))
        .where("a < b")
        .select("src", "place", "epoch", "a", "b", F.explode(F.expr(f"sequence(a div {block}, (b - 1) div {block})")).alias("rank"))
        .withColumn("from", F.greatest(F.col("a"), F.col("rank") * block))
        .withColumn("to", F.least(F.col("b"), (F.col("rank") + 1) * block))
        .join(slots.hint("merge"), ["src", "rank"])
        .select("slot", "src", "place", "epoch", (F.col("from") - F.col("a")).alias("first"), (F.col("to") - F.col("from")).alias("words"))
    )
    return Mix(placed, slots, pieces)


def taken(mix: Mix) -> DataFrame:
    """mix.placed with taken, the words that the mix takes of a document, repeats counted."""
    used = mix.pieces.groupBy("src", "place").agg(F.sum("words").alias("used"))
    one = F.when(F.col("size") > 0, F.col("place")).otherwise(F.lit(-1))
    return (
        mix.placed.withColumn("key", one)
        .join(used.withColumnRenamed("place", "key").hint("merge"), ["src", "key"], "left")
        .withColumn("taken", F.coalesce("used", F.lit(0).cast("long")))
        .drop("used", "key")
    )


def mixed_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """docs as the mix has them: a document as often as it is taken, to the nearest whole number.

    Same defined cases as mix_sources.  Documents without words go.  Each row keeps its own columns.
    """
    many = taken(mix_sources(docs, id_col, text_col, **options))
    times = F.expr("(2 * taken + size) div (2 * size)")
    copies = many.where("size > 0").withColumn("n", times.cast("int")).where("n > 0").select("id", "text_key", "row", "n")
    packed = pack(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    texts = packed.select("id", "text_key", "text").dropDuplicates(["id", "text_key"])
    rows = texts.join(copies, ["id", "text_key"]).select(
        "row", "text", F.explode(F.sequence(F.lit(1), "n")).alias("copy")
    )
    return unpack(rows, docs, text_col, {})
