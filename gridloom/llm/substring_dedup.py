"""Substring dedup by super-k-mer partitioning.

A window is k consecutive words.  Its minimiser is the smallest hash of its m-word stretches.
Consecutive windows of one text that share a minimiser travel as one packed string, so their
common words move once, and windows with the same words always meet in the minimiser's bucket.
There they are sorted and counted exactly: equal hashes are compared word by word.

A minimiser that very many unlike strings share, such as one in a frequent line with ever new
neighbours, is dealt out by a second one: its strings are cut again where the smallest hash of
their other stretches changes, and each part goes to the bucket of both hashes.  Which minimisers
these are is estimated from a part of the texts; it decides where windows are counted, never
which, as the cut follows from a window's words alone.

A task adds up equal strings before it sends them, so a passage that a large part of all
documents repeat arrives once per task, however often it occurs.  A bucket's answer is per
string: which of its windows start somewhere else too.  Texts are cut into the same strings
again and meet the answers by the strings' digests, in an equi-join that Spark splits where a
string is frequent; then each document's ranges are removed from it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .common import pack, unpack, written

#: Words of a stretch whose hash may be a minimiser.
STRETCH = 6
#: One in so many texts, by hash, tells the heavy minimisers and the number of buckets.
PART_OF = 64
#: Bytes of strings of a bucket, about, and of a minimiser that is dealt out by a second one.
BUCKET, HEAVY = 12_000_000, 24_000_000
#: Bytes of strings that a task holds before it sends them, and of texts that it cuts at once.
HELD, AT_ONCE = 24_000_000, 4_000_000


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _word_hashes(words):
    """(hash of each word, the words' ids in order, lengths) of an Arrow array."""
    import numpy as np
    import pyarrow.compute as pc
    import xxhash

    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False)
    known = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
    return hashes[ids], ids, pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def _least(x, reach: int):
    """Smallest of each `reach` consecutive values."""
    import numpy as np

    span = 1
    while 2 * span <= reach:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (reach - span)], x[reach - span :]) if span < reach else x


def cut(texts: list[bytes], k: int, heavy=(), m: int = STRETCH):
    """The super-k-mers of texts: (text, first word, windows, minimiser, packed string) columns.

    heavy: sorted minimisers whose windows are cut by a second one too; both are in the
    minimiser's column then, mixed."""
    import numpy as np
    import pyarrow as pa

    split = [t.split() for t in texts]
    sizes = np.fromiter((len(s) for s in split), np.int64, len(split))
    flat = [w for s in split if len(s) >= k for w in s]
    long = np.flatnonzero(sizes >= k)
    if not len(long):
        return [], [], [], [], []
    hashes, _, lengths = _word_hashes(pa.array(flat, pa.large_binary()))
    n = len(flat)
    ends = np.cumsum(sizes[long])
    starts = ends - sizes[long]
    stretch = np.zeros(n - m + 1, np.uint64)
    for j in range(m):
        stretch = stretch * np.uint64(0xD6E8FEB86659FD93) + hashes[j : n - m + 1 + j]
    mixed = _mixed(stretch)
    low = _least(mixed, k - m + 1)
    # low[p]: the minimiser of the window that starts at word p; windows across texts are left out
    inside = np.ones(n - k + 1, bool)
    for e in ends[:-1]:
        inside[max(0, e - k + 1) : e] = False
    at = np.flatnonzero(inside)
    least = low[at]
    if len(heavy):
        many = np.isin(least, heavy)
        if many.any():
            rest = _least(np.where(np.isin(mixed, heavy), np.uint64(2**64 - 1), mixed), k - m + 1)
            least[many] = _mixed(least[many] ^ (rest[at[many]] * np.uint64(0xA24BAED4963EE407)))
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    begin = at[first]
    offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
    buffer = b" ".join(flat)
    a, b = offsets[begin].tolist(), (offsets[begin + count + k - 1] - 1).tolist()
    strings = [buffer[x:y] for x, y in zip(a, b, strict=True)]
    owner = np.searchsorted(ends, begin, side="right")
    return long[owner].tolist(), (begin - starts[owner]).tolist(), count.tolist(), least[first], strings


def _slices(batch, column: str):
    """(first row, texts as bytes) of parts of the batch of bounded size; one text may exceed it."""
    import pyarrow as pa

    texts = batch.column(column).cast(pa.binary()).to_pylist()
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > AT_ONCE:
            yield lo, texts[lo:i]
            lo, size = i, 0
        size += len(t)
    if texts[lo:]:
        yield lo, texts[lo:]


def _send(k: int, buckets: int, heavy: list[int]):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        pack_up = zstandard.ZstdCompressor(level=3).compress

        def sent(held):
            keys, bodies = list(held), []
            for b in keys:
                counts = np.fromiter(held[b].values(), "<u4", len(held[b]))
                bodies.append(pack_up(len(counts).to_bytes(4, "little") + counts.tobytes() + b"\n".join(held[b])))
                held[b] = {}
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int32()), pa.array(bodies, pa.binary())], names=["bucket", "body"]
            )

        most = np.array(heavy, np.uint64)
        held: dict[int, dict[bytes, int]] = {}
        size = 0
        for batch in batches:
            for _, texts in _slices(batch, "text"):
                _, _, _, least, strings = cut(texts, k, most)
                if not strings:
                    continue
                for b, s in zip((_mixed(least) % np.uint64(buckets)).tolist(), strings, strict=True):
                    own = held.setdefault(b, {})
                    if s in own:
                        own[s] += 1
                    else:
                        own[s] = 1
                        size += len(s)
                if size > HELD:
                    yield sent(held)
                    held, size = {}, 0
        if held:
            yield sent(held)

    return run


def _weigh(k: int):
    """(minimiser, bytes): of the unlike strings of a task."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for _, texts in _slices(batch, "text"):
                _, _, _, least, strings = cut(texts, k)
                if not strings:
                    continue
                one = dict(zip(strings, least.view(np.int64).tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(one.values()), pa.int64()), pa.array([len(s) for s in one], pa.int64())],
                    names=["least", "bytes"],
                )

    return run


def spread_of(packed: DataFrame, k: int) -> tuple[int, list[int]]:
    """(number of buckets, heavy minimisers) for the texts, estimated from one in PART_OF."""
    some = packed.where(F.pmod("text_key", F.lit(PART_OF)) == 0).select("text")
    sizes = some.mapInArrow(_weigh(k), "least long, bytes long").groupBy("least").agg(F.sum("bytes").alias("bytes"))
    sizes = sizes.cache()
    total = (sizes.agg(F.sum("bytes")).first()[0] or 0) * PART_OF
    # at most total / HEAVY of them
    heavy = sizes.where(F.col("bytes") * PART_OF > HEAVY).select("least").collect()
    sizes.unpersist()
    return -(-total // BUCKET), sorted(r.least % 2**64 for r in heavy)


def repeated(strings: dict[bytes, int], k: int) -> list[tuple[bytes, bytes]]:
    """(string, bits) of the strings with windows that occur twice or more; a bit for each window."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    packed = list(strings)
    times = np.fromiter(strings.values(), np.int64, len(packed))
    split = pc.split_pattern(pa.array(packed, pa.large_binary()), " ")
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    hashes, ids, _ = _word_hashes(split.flatten())
    del split
    windows = sizes - (k - 1)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(packed)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = first[owner] + place
    base = 0xA0761D6478BD642F
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(len(hashes), base, np.uint64))
        down = np.cumprod(np.full(len(hashes), pow(base, -1, 1 << 64), np.uint64))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up)))
        value = _mixed((total[at + k] - total[at]) * down[at])
    order = np.argsort(value)
    ranked, spot = value[order], at[order]
    equal = ranked[1:] == ranked[:-1]
    pair = np.flatnonzero(equal)
    same = np.ones(len(pair), bool)
    for j in range(k):
        same &= ids[spot[pair] + j] == ids[spot[pair + 1] + j]
    twice = np.zeros(len(at), bool)
    if same.all():
        group = np.concatenate(([0], np.cumsum(~equal)))
        weight = np.bincount(group, times[owner[order]])
        twice[order] = weight[group] > 1.5
    else:  # equal hashes of unlike windows: sort by the words themselves
        table = np.stack([ids[at + j] for j in range(k)], axis=1)
        _, group = np.unique(table, axis=0, return_inverse=True)
        twice = np.bincount(group.ravel(), times[owner])[group.ravel()] > 1.5
    out = []
    edge = np.cumsum(windows)
    some = np.flatnonzero(np.add.reduceat(twice, edge - windows))
    for i in some.tolist():
        bits = twice[edge[i] - windows[i] : edge[i]]
        out.append((packed[i], np.packbits(bits, bitorder="little").tobytes()))
    return out


def _digest(string: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(string, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _count(k: int):
    def run(table):
        import numpy as np
        import pyarrow as pa
        import zstandard

        unpack_it = zstandard.ZstdDecompressor().decompress
        strings: dict[bytes, int] = {}
        for body in table.column("body"):
            data = unpack_it(body.as_py())
            n = int.from_bytes(data[:4], "little")
            for s, c in zip(data[4 + 4 * n :].split(b"\n"), np.frombuffer(data, "<u4", n, 4).tolist(), strict=True):
                strings[s] = strings.get(s, 0) + c
        found = repeated(strings, k)
        keys = [_digest(s) for s, _ in found]
        return pa.table(
            {
                "d1": pa.array([a for a, _ in keys], pa.int64()),
                "d2": pa.array([b for _, b in keys], pa.int64()),
                "bits": pa.array([b for _, b in found], pa.binary()),
            }
        )

    return run


def _ask(k: int, heavy: list[int]):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        most = np.array(heavy, np.uint64)
        for batch in batches:
            for lo, texts in _slices(batch, "text"):
                owner, first, _, _, strings = cut(texts, k, most)
                keys = [_digest(s) for s in strings]
                rows = pa.array([lo + i for i in owner], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(rows),
                        batch.column("text_key").take(rows),
                        pa.array(first, pa.int32()),
                        pa.array([a for a, _ in keys], pa.int64()),
                        pa.array([b for _, b in keys], pa.int64()),
                    ],
                    names=["id", "text_key", "first", "d1", "d2"],
                )

    return run


def _remove(k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for lo, texts in _slices(batch, "text"):
                n, gone, kept = [], [], []
                answers = batch.column("answers").slice(lo, len(texts)).to_pylist()
                for text, found in zip(texts, answers, strict=True):
                    words = text.split()
                    change = np.zeros(len(words) + 1, np.int64)
                    for a in found or ():
                        bits = np.unpackbits(np.frombuffer(a["bits"], np.uint8), bitorder="little")
                        starts = a["first"] + np.flatnonzero(bits)
                        change[starts] += 1
                        change[starts + k] -= 1
                    covered = np.cumsum(change[:-1]) > 0
                    n.append(len(words))
                    gone.append(int(covered.sum()))
                    if gone[-1]:
                        words = [words[i] for i in np.flatnonzero(~covered).tolist()]
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(lo, len(texts)), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                    names=["row", "n_words", "n_removed", "text"],
                )

    return run


def dedup_substrings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 35,
    buckets: int | None = None,
) -> DataFrame:
    """docs with the text left, n_words and n_removed.

    Words are what stands between white space.  A word goes if a window of k consecutive words
    that covers it has the same words as a window that starts anywhere else, in the same text
    included; windows are judged on the input.  The words left are joined by one space.

    buckets: of minimisers; if not given eight for each shuffle partition, and more where the
    strings are over BUCKET bytes each.  A bucket is what one task holds at once.

    A null or empty text has no words and comes back empty.  Each row is a text of its own, so
    repeated rows lose what they share, wherever it stands.  A null id is an id like others.  An
    empty table gives an empty table.
    """
    if k <= STRETCH:
        raise ValueError(f"k must be over {STRETCH}")
    spark = docs.sparkSession
    packed = pack(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    enough, heavy = spread_of(packed, k)
    buckets = buckets or max(enough, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    answers = written(
        packed.select("text")
        .mapInArrow(_send(k, buckets, heavy), "bucket int, body binary")
        .groupBy("bucket")
        .applyInArrow(_count(k), "d1 long, d2 long, bits binary"),
        "repeated-windows",
    )
    asked = packed.select("id", "text_key", "text").mapInArrow(
        _ask(k, heavy), "id long, text_key long, first int, d1 long, d2 long"
    )
    found = (
        asked.join(answers, ["d1", "d2"])
        .groupBy("id", "text_key")
        .agg(F.collect_set(F.struct("first", "bits")).alias("answers"))
    )
    joined = packed.join(found, ["id", "text_key"], "left").select("row", "text", "answers")
    out = StructType().add("row", packed.schema["row"].dataType).add("n_words", LongType())
    out = out.add("n_removed", LongType()).add("text", StringType())
    done = joined.mapInArrow(_remove(k), out)
    return unpack(done, docs, text_col, {text_col: F.col("text"), "n_words": F.col("n_words"), "n_removed": F.col("n_removed")})
