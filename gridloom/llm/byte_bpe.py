"""Byte-level BPE by a monoid tree reduction.

The elements are valid token sequences; the product of two is the encoding of both stretches
of bytes.  A stretch is encoded by halves, and the halves are joined.  Two facts make the join
exact.  A sequence is the encoding of its bytes if and only if each pair of neighbours is the
encoding of the pair's bytes; and only one sequence has that property.  So when the tokens at
the seam are re-encoded, and the pairs at both edges of that window hold, nothing outside the
window can change.  Otherwise the window doubles
on the side that fails.

A text is one such tree.  Its upper joints lie between matches of the splitting pattern, where
nothing merges, so there the product is concatenation; below them each match is reduced by
halves, down to leaves of a few bytes, so words of ordinary length are joined.  Decoding
concatenates up the same tree.  A task keeps the results for short stretches and matches, which
are most of all text, within a bound.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from .common import pack, unpack

#: Bytes up to which a stretch is encoded as one leaf, and matches that are put together at once.
LEAF, ROW = 4, 256
#: Bytes up to which neighbours are searched one by one, without a heap.
SHORT = 96
#: Matches of this many bytes at most are kept, and so many of them.
KEEP_BYTES, KEEP = 64, 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class _Kept(dict):
    """What a match is encoded as, worked out when it is first asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, text: str) -> tuple[int, bytes, bytes]:
        out = self.encode(text)
        if len(out[2]) <= KEEP_BYTES:
            if len(self) >= KEEP:
                self.clear()
            self[text] = out
        return out


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        import regex

        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.leaf = leaf
        self.pairs: dict[tuple[int, int], bool] = {}
        self.short: dict[bytes, list[int]] = {}
        self.joins = 0
        self.of = _Kept(self.piece).__getitem__

    def stretch(self, data: bytes) -> list[int]:
        """merge(data), kept for short stretches."""
        if len(data) > KEEP_BYTES:
            return self.merge(data)
        if (known := self.short.get(data)) is None:
            if len(self.short) >= KEEP:
                self.short.clear()
            known = self.short[data] = self.merge(data)
        return known

    def merge(self, data: bytes) -> list[int]:
        """The ids of a stretch, merging the neighbours of the lowest rank, the first on ties."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        if len(data) > SHORT:
            return self.merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        worst = len(self.ranks)
        joined = [self.ranks.get(a + b, worst) for a, b in zip(parts, parts[1:], strict=False)]
        while joined and (low := min(joined)) < worst:
            at = joined.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = self.ranks.get(parts[at - 1] + parts[at], worst)
            if at < len(joined):
                joined[at] = self.ranks.get(parts[at] + parts[at + 1], worst)
        return [self.ranks[p] for p in parts]

    def merge_long(self, data: bytes) -> list[int]:
        """The same with a heap of neighbours, in n log n."""
        n = len(data)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.ranks.get(data[i : end[j]])) is not None:
                heappush(heap, (rank, i, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, middle, stop = heappop(heap)
            j = after[i]
            if end[i] != middle or j >= n or end[j] != stop:
                continue  # one of the two has been merged since
            end[i], end[j], after[i] = stop, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = after[i]
        return out

    def stable(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes are encoded as just these two."""
        pair = (left, right)
        if (known := self.pairs.get(pair)) is None:
            known = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            if len(self.pairs) >= KEEP:
                self.pairs.clear()
            self.pairs[pair] = known
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        self.joins += 1
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        a, b = 1, 1
        while True:
            inner = b"".join(map(self.bytes_of.__getitem__, left[len(left) - a :] + right[:b]))
            window = self.stretch(inner)
            ok_left = a == len(left) or self.stable(left[-a - 1], window[0])
            ok_right = b == len(right) or self.stable(window[-1], right[b])
            if ok_left and ok_right:
                return left[: len(left) - a] + window + right[b:]
            a = a if ok_left else min(2 * a, len(left))
            b = b if ok_right else min(2 * b, len(right))

    def encode_bytes(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf:
            return self.stretch(data)
        half = len(data) // 2
        return self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def decode_bytes(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode_bytes(ids[:half]) + self.decode_bytes(ids[half:])

    def piece(self, text: str) -> tuple[int, bytes, bytes]:
        """Of one match: number of ids, the ids in decimal joined by commas, their bytes."""
        ids = self.encode_bytes(text.encode())
        return len(ids), ",".join(map(str, ids)).encode(), self.decode_bytes(ids)

    def reduce(self, matches: list[str]) -> tuple[int, bytes, bytes]:
        """What piece() gives, of consecutive matches, by halves."""
        if len(matches) <= ROW:
            if not matches:
                return 0, b"", b""
            count, ids, decoded = zip(*map(self.of, matches), strict=True)
            return sum(count), b",".join(ids), b"".join(decoded)
        half = len(matches) // 2
        (n, a, x), (m, b, y) = self.reduce(matches[:half]), self.reduce(matches[half:])
        return n + m, a + b"," + b, x + y

    def encode(self, text: str) -> list[int]:
        ids = self.reduce(self.pieces(text))[1]
        return list(map(int, ids.split(b","))) if ids else []


def _encoder(ranks, pattern: str, want_ids: bool):
    def run(batches):
        import pyarrow as pa

        bpe = ByteBpe(ranks.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, ids, sha, back, lists = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    count, joined, decoded = bpe.reduce(bpe.pieces(text))
                    n.append(count)
                    sha.append(hashlib.sha256(joined).hexdigest())
                    back.append(hashlib.sha256(decoded).hexdigest())
                    if want_ids:
                        lists.append(list(map(int, joined.split(b","))) if joined else [])
                columns = [part.column("row"), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)]
                names = ["row", "n_tokens", "ids_sha256", "decoded_sha256"]
                if want_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_bpe(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    want_ids: bool = True,
) -> DataFrame:
    """docs without the text, with n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 (of the decoded bytes) and, if wanted, ids (array<int>).

    ranks_path: a rank file on the driver, a line for each token: its bytes in base 64, its
    rank.  pattern: what splits a text.  There are no special tokens; text that looks like one
    is text.

    A null or empty text has no ids.  Each row is encoded by itself, without a shuffle; an
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))  # as large as the vocabulary
    packed = pack(docs, id_col, text_col).select("row", "text")
    out = StructType().add("row", packed.schema["row"].dataType).add("n_tokens", LongType())
    out = out.add("ids_sha256", StringType()).add("decoded_sha256", StringType())
    out = out.add("ids", ArrayType(IntegerType())) if want_ids else out
    done = packed.mapInArrow(_encoder(ranks, pattern, want_ids), out)
    new = {c: F.col(c) for c in out.fieldNames() if c != "row"}
    return unpack(done, docs.drop(text_col), text_col, new)
