"""SimHash near-dedup with pigeonring filtering.

The 64 bits of a fingerprint form a ring of tau + 1 segments.  If two fingerprints differ in
tau bits at most, then from some segment on every chain of consecutive segments stays within
its share of tau: a chain of l segments differs in l * tau / (tau + 1) bits at most, rounded
down.  So the first segment of that chain is equal and the second differs in one bit at most;
a fingerprint looks its partners up by these two segments, with each bit of the second flipped
in turn.  Longer chains and then the full distance are checked in the same join.

Equal fingerprints are one vertex from the start, so exact copies make no pairs, and a cloud of
unlike ones is linked through a representative of each key instead of pair by pair.  Components
come from alternating large-star and small-star steps on tables in the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, name, pack, written

BITS = 64


def fingerprint(text: bytes, size: int = 4, seed: int = 42) -> int:
    """Bit b is set if it is set in over half of the hashes of the text's shingles."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and white space of ASCII only
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    n = max(1, len(words) - size + 1)
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, n, 1 << 14):
        m = min(n, lo + (1 << 14)) - lo
        h = np.fromiter((hashed(b" ".join(words[i : i + size]), seed) for i in range(lo, lo + m)), "<u8", m)
        ones += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(size: int, seed: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = [fingerprint(t.as_py(), size, seed) for t in texts]
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, kept), pa.array(found, pa.int64())], names=[*kept, "fp"]
            )

    return run


def _ring(tau: int) -> list[tuple[int, int]]:
    """(first bit, width) of tau + 1 segments."""
    edges = [round(i * BITS / (tau + 1)) for i in range(tau + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _turned(fp: Column, by: int) -> Column:
    """fp turned right, so that bit `by` becomes bit 0."""
    return fp if by == 0 else F.shiftrightunsigned(fp, by).bitwiseOR(F.shiftleft(fp, BITS - by))


def _low(n: int) -> Column:
    return F.lit((1 << n) - 1 if n < BITS else -1).cast("long")


def _chains(tau: int, start: int) -> list[tuple[int, int]]:
    """(bits, most differences) of each chain from the segment start on."""
    ring, out, bits = _ring(tau), [], 0
    for length in range(1, len(ring) + 1):
        bits += ring[(start + length - 1) % len(ring)][1]
        out.append((bits, length * tau // (tau + 1)))
    return out


def _within(a: Column, b: Column, i: Column, tau: int) -> Column:
    """Whether a and b differ in tau bits at most, and all chains from the segment i on keep to
    their shares."""
    x = a.bitwiseXOR(b)
    longer = F.lit(False)
    for k, (start, _) in enumerate(_ring(tau)):
        held = i == k
        for bits, most in _chains(tau, k)[2:]:
            held &= F.bit_count(_turned(x, start).bitwiseAND(_low(bits))) <= most
        longer |= held
    return longer & (F.bit_count(x) <= tau)


def _looked_up(vertices: DataFrame, tau: int) -> tuple[DataFrame, DataFrame]:
    """(probes (a, i, key), index (b, i, key)): partners meet where i and key are equal."""
    if tau < 1:
        raise ValueError("tau must be 1 or more")
    ring = _ring(tau)
    index, probes = [], []
    for i in range(len(ring)):
        first, both = ring[i][1], _chains(tau, i)[1][0]
        flips = [0] + [1 << b if b < BITS - 1 else -(1 << b) for b in range(first, both)]
        spots = [F.struct(F.lit(i).alias("i"), F.lit(f).cast("long").alias("flip")) for f in flips]
        index.append(spots[0])
        probes += spots
        assert _chains(tau, i)[0][1] == 0 and _chains(tau, i)[1][1] <= 1

    def key(fp: Column, i: Column) -> Column:
        each = [_turned(fp, a).bitwiseAND(_low(_chains(tau, k)[1][0])) for k, (a, _) in enumerate(ring)]
        return reduce(lambda c, k: c.when(i == k, each[k]), range(1, len(ring)), F.when(i == 0, each[0]))

    def dealt(spots: list[Column], fp: str) -> DataFrame:
        e = F.col("e")
        return (
            vertices.select(F.col("fp").alias(fp), F.explode(F.array(*spots)).alias("e"))
            .select(fp, e["i"].alias("i"), key(F.col(fp), e["i"]).bitwiseXOR(e["flip"]).alias("key"))
        )

    return dealt(probes, "a"), dealt(index, "b")


def near_pairs(vertices: DataFrame, tau: int = 4) -> DataFrame:
    """All pairs (a, b) of the distinct fingerprints fp with a < b and at most tau differing bits."""
    probes, index = _looked_up(vertices, tau)
    same = (F.col("p.i") == F.col("q.i")) & (F.col("p.key") == F.col("q.key"))
    within = (F.col("a") < F.col("b")) & _within(F.col("a"), F.col("b"), F.col("p.i"), tau)
    return probes.alias("p").join(index.alias("q"), same & within).select("a", "b").distinct()


def near_links(vertices: DataFrame, tau: int = 4) -> DataFrame:
    """Pairs (a, b) of fingerprints of at most tau differing bits that link what all such pairs
    link, without all pairs of a cloud.

    Each key has a representative, the smallest fingerprint in its index.  What is near it is
    linked to it, and two that are near it needn't meet; only what isn't near it meets the rest.
    """
    probes, index = _looked_up(vertices, tau)
    near = lambda c: F.bit_count(F.col(c).bitwiseXOR(F.col("rep"))) <= tau
    reps = index.groupBy("i", "key").agg(F.min("b").alias("rep"))
    # a probe whose key isn't in the index has no partners
    asked = probes.join(reps, ["i", "key"]).withColumn("covered", near("a"))
    found = index.join(reps, ["i", "key"]).withColumn("covered", near("b"))
    to_rep = asked.where("covered and a <> rep").select("a", F.col("rep").alias("b"))
    left = asked.select("a", "i", "key", "covered").alias("p")
    # whoever isn't covered meets all of the key; the covered meet those who aren't
    both = found.select("b", "i", "key", F.explode(F.when(F.col("covered"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("covered")).alias("q")
    same = (F.col("p.i") == F.col("q.i")) & (F.col("p.key") == F.col("q.key")) & (F.col("p.covered") == F.col("q.covered"))
    unlike = (F.col("a") != F.col("b")) & _within(F.col("a"), F.col("b"), F.col("p.i"), tau)
    return to_rep.union(left.join(both, same & unlike).select("a", "b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()


def _stars(pairs: DataFrame) -> bool:
    """Whether each v of the pairs (v, m) has one m, which is no v itself."""
    end = lambda x, below: F.struct(F.col(x).alias("x"), F.lit(below).alias("below"), F.lit(1 - below).alias("top"))
    ends = pairs.select(F.inline(F.array(end("v", 1), end("m", 0))))
    at = ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("top").alias("top"))
    return at.where("below + top > 1").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(vertex, root) of each vertex of edges (a, b); root is its component's smallest vertex.

    Each round is one table in the shared folder; a lost executor costs no earlier round.  The
    rounds end when all pairs form stars; as v > m in each, a star's centre is its smallest vertex.
    """
    now = written(
        edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m").distinct(),
        label,
    )
    pair = lambda a, x, b, y: F.struct(F.col(a).alias(x), F.col(b).alias(y))
    while not _stars(now):
        # both ways in one pass, not by a union, which would run what it reads once for each way
        both = now.select(F.inline(F.array(pair("v", "u", "m", "w"), pair("m", "u", "v", "w"))))
        least = both.groupBy("u").agg(F.least("u", F.min("w")).alias("m"))
        # repeated pairs stay until the end of the round; there are no more of them than of both
        large = both.join(least, "u").where(F.col("w") > F.col("u")).select(F.col("w").alias("v"), "m").where("v <> m")
        lowest = large.groupBy("v").agg(F.min("m").alias("low"))
        pulled = large.join(lowest, "v")
        own, other = pair("v", "v", "low", "m"), pair("m", "v", "low", "m")
        small = pulled.select(F.inline(F.when(F.col("m") == F.col("low"), F.array(own)).otherwise(F.array(own, other))))
        now = written(small.distinct(), label)
    roots = now.select(F.col("m").alias("vertex"), F.col("m").alias("root")).distinct()
    return now.select(F.col("v").alias("vertex"), F.col("m").alias("root")).union(roots)


def _rooted(found: DataFrame, first: Column, tau: int) -> DataFrame:
    """(fp, first, root) of each fingerprint of found; first is the least of its rows' values."""
    vertices = written(found.groupBy("fp").agg(F.min(first).alias("first")), "simhash-vertices")
    linked = components(near_links(vertices, tau), "simhash-components")
    return vertices.join(linked, vertices.fp == linked.vertex, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4,
    seed: int = 42,
    tau: int = 4,
) -> DataFrame:
    """(id_col, fingerprint, component_id) of each row of docs.

    A text's A-Z are lower-cased, its shingles are `size` consecutive words (all words of a
    shorter text), repeats included, hashed by XXH64.  A text without words has the fingerprint
    zero and is linked like any other.  Fingerprints of at most tau differing bits are linked;
    component_id is the smallest id that links lead to, the row's own included.

    A null text has no words.  A null id comes after all others; a component of null ids alone
    has a null component_id.  Rows of the same id are rows of their own; an empty table gives an
    empty table.  Other columns are left out.
    """
    found = written(
        pack(docs, id_col, text_col)
        .select("id", "text")
        .mapInArrow(_fingerprints(size, seed), "id long, fp long"),
        "simhash",
    )
    rooted = _rooted(found, F.col("id"), tau)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    members = rooted.join(smallest, "root").select("fp", "component")
    given = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.join(members, "fp").select(
        given("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        given("component").alias("component_id"),
    )


def representatives(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4,
    seed: int = 42,
    tau: int = 4,
) -> DataFrame:
    """One row of docs for each component of linked texts, the one with the smallest id.

    Texts are linked as by near_duplicates.  Where rows of a component share the smallest id, or
    have no ids, a digest of the whole row decides.  So rows with a null or a repeated id stay
    apart unless their texts are linked.
    """
    every = [F.col(name(c)) for c in docs.columns]
    rest = F.struct(*[F.col(name(c)) for c in docs.columns if c != text_col])
    text = F.col(name(text_col))
    # without the text's digest where the text is null
    key = F.concat_ws(":", F.sha2(text.cast("binary"), 256), F.sha2(F.to_json(rest).cast("binary"), 256))
    keyed = docs.select(
        F.coalesce(F.col(name(id_col)).cast("long"), F.lit(NO_ID)).alias("id"),
        key.alias("key"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.struct(*every).alias("row"),
    )
    found = written(
        keyed.select("id", "key", "text").mapInArrow(_fingerprints(size, seed), "id long, key string, fp long"),
        "simhash",
    )
    rooted = _rooted(found, F.struct("id", "key"), tau)
    chosen = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.id", "first.key")
    # rows of one key are copies of each other
    kept = keyed.join(chosen, ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    return kept.select(*[F.col(f"row.{name(c)}") for c in docs.columns])
