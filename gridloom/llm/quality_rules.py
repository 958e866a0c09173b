"""Quality rules whose thresholds adapt to each language and source.  Native: no Python
runs on the executors.

Each document is reduced to a few whole numbers.  Four ratios of them go into quantile
sketches, one per (lang, source) and ratio: counts in buckets whose width is a fixed part of
their value (five leading bits, so a relative error under 1/16).  Such sketches merge by
adding counts, in any order and with the same result, so one source with a third of all rows
is combined before the shuffle.  Fences far outside the middle half of a sketch replace fixed
cut-offs; the documents are joined to the fences of their language and source and filtered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, name, pack, unpack, words, written

SYMBOLS = "#*$%&|<>"
#: ratio -> default of the least distance of its fences from the quartiles
RATIOS = {"r_symbols": 100, "r_length": 200, "r_lines": 500, "r_repeat": 300}
#: Bits of a value that a sketch keeps.
KEPT_BITS = 5
#: Copies of the fences, so that the documents of one source are joined in as many parts.
PARTS = 16


def _repeated_words(w: Column, span: int = 3) -> Column:
    """How many words lie in windows of span words that the text has twice or more."""

    def count(t: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(t) - span),
            lambda i: F.xxhash64(*[F.get(t, i + k) for k in range(span)]),
        )
        return let(windows, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), 0).otherwise(covered(x)))

    def covered(x: Column) -> Column:
        placed = F.sort_array(F.transform(x, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        near = lambda s, k, h: F.get(s, k)["h"].eqNullSafe(h)
        twice = lambda s: F.filter(
            s, lambda e, k: near(s, k - 1, e["h"]) | near(s, k + 1, e["h"])
        )
        starts = let(placed, lambda s: F.sort_array(F.transform(twice(s), lambda e: e["i"])))
        return let(
            starts,
            lambda p: F.aggregate(
                F.transform(p, lambda v, k: F.least(F.lit(span), F.coalesce(F.get(p, k + 1) - v, F.lit(span)))),
                F.lit(0),
                lambda a, v: a + v,
            ),
        )

    hashed = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) < span, 0).otherwise(let(hashed, count)).cast("long")


def measures(text: Column) -> Column:
    """The whole numbers of a text, as a struct."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(t: Column) -> Column:
        w, ls = t["w"], t["ls"]
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(F.array_join(w, ""), F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            F.size(ls).cast("long").alias("n_lines"),
            _repeated_words(w).alias("n_repeat_words"),
        )

    return let(F.struct(words(text).alias("w"), lines.alias("ls")), of)


def _ratio(top: str, factor: int, bottom: str) -> Column:
    return F.expr(f"({top} * {factor}) div greatest({bottom}, 1)")


#: The lowest value of v's bucket: v with all but its leading bits cleared.
_BUCKET = "shiftleft(shiftright(v, {0}), {0})".format(f"greatest(0, length(bin(v)) - {KEPT_BITS})")


def fences(measured: DataFrame, keys: list[str], spread: int, worth: int, least: dict[str, int]) -> DataFrame:
    """One row per key: lo_ and hi_ of each ratio, from the key's quartiles, drawn towards those of
    all documents as if `worth` documents more had these."""
    ratios = F.explode(
        F.array(*[F.struct(F.lit(r).alias("ratio"), F.col(r).alias("v")) for r in RATIOS])
    )
    cells = (
        measured.select(*keys, ratios.alias("e"))
        .select(*keys, "e.ratio", F.col("e.v").alias("v"))
        .withColumn("bucket", F.expr(_BUCKET))
        .groupBy(*keys, "ratio", "bucket")
        .agg(F.count("*").alias("n"))
    )

    def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
        part = Window.partitionBy(*by, "ratio")
        return (
            sketch.withColumn("all", F.sum("n").over(part))
            .withColumn("upto", F.sum("n").over(part.orderBy("bucket")))
            .groupBy(*by, "ratio")
            .agg(
                F.first("all").alias("docs"),
                F.min(F.when(F.col("upto") * 4 >= F.col("all"), F.col("bucket"))).alias("q1"),
                F.min(F.when(F.col("upto") * 4 >= F.col("all") * 3, F.col("bucket"))).alias("q3"),
            )
        )

    merged = cells.groupBy("ratio", "bucket").agg(F.sum("n").alias("n"))
    whole = quartiles(merged, []).select(
        "ratio", F.col("q1").alias("w1"), F.col("q3").alias("w3")
    )
    own = quartiles(cells, keys).join(F.broadcast(whole), "ratio")  # whole: a row per ratio
    q1, q3 = (F.expr(f"(docs * q{k} + {worth} * w{k}) div (docs + {worth})") for k in (1, 3))
    lowest = F.create_map(*[F.lit(x) for r in RATIOS for x in (r, least[r])])[F.col("ratio")]
    reach = F.greatest((q3 - q1) * spread, lowest)
    return (
        own.select(*keys, "ratio", (q1 - reach).alias("lo"), (q3 + reach).alias("hi"))
        .groupBy(*keys)
        .agg(
            *[
                F.max(F.when(F.col("ratio") == r, F.col(side))).alias(f"{side}_{r}")
                for r in RATIOS
                for side in ("lo", "hi")
            ]
        )
    )


def judge_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_words: int = 50,
    spread: int = 4,
    worth: int = 30,
    least: dict[str, int] | None = None,
) -> DataFrame:
    """docs without the text, with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed and kept.

    base_failed: fewer than min_words words, or over half of the words in repeated three-word
    windows.  The sketches hold the documents that pass.  A document is kept if it passes, and
    symbols per word, repeated lines and repeated words stay at or under the upper fence of its
    language and source and the mean word length is within both.  A fence is spread times the
    distance of the quartiles away from them.

    worth: documents with the quartiles of the whole that each language and source counts besides
    its own, so that few documents hardly move a fence.  least: the least distance of a fence from
    its quartile, which matters where half of all documents agree and the quartiles' distance says
    nothing; as given a tenth of a symbol per word, two characters, half of the lines, three
    tenths of the words.

    A null text has no words and fails.  A null language or source is a group of its own.
    Equal rows get equal results; an empty table gives an empty one.  Text is never shuffled:
    the measures of all documents are written to the shared folder once, and read twice.
    """
    measured = written(
        pack(docs, id_col, text_col)
        .select(
            "id",
            "row",
            F.col(f"row.{name(lang_col)}").alias("k_lang"),
            F.col(f"row.{name(source_col)}").alias("k_source"),
            measures(F.col("text")).alias("m"),
        )
        .select("id", "row", "k_lang", "k_source", "m.*")
        .withColumns(
            {
                "r_symbols": _ratio("n_symbols", 1000, "n_words"),
                "r_length": _ratio("word_chars", 100, "n_words"),
                "r_lines": _ratio("n_dup_lines", 1000, "n_lines"),
                "r_repeat": _ratio("n_repeat_words", 1000, "n_words"),
                "base_failed": (F.col("n_words") < min_words)
                | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50),
            }
        ),
        "quality-rules",
    )
    by = ["k_lang", "k_source"]
    limits = fences(measured.where(~F.col("base_failed")), by, spread, worth, RATIOS | (least or {}))
    parts = limits.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).select(
        *[F.col(k).alias(f"f_{k}") for k in by], "part", *[c for c in limits.columns if c not in by]
    )
    dealt = measured.withColumn("f_part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"))
    on = F.col("f_part") == F.col("part")
    for k in by:
        on &= F.col(k).eqNullSafe(F.col(f"f_{k}"))
    joined = dealt.join(parts, on, "left")
    fits = F.lit(True)
    for r in RATIOS:
        fits &= F.col(r) <= F.col(f"hi_{r}")
    fits &= F.col("r_length") >= F.col("lo_r_length")
    kept = ~F.col("base_failed") & F.coalesce(fits, F.lit(False))
    new = {c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")}
    return unpack(joined, docs.drop(text_col), text_col, new | {"kept": kept})
