"""Media columns: content-addressed payloads in tar shards.

A payload is stored as an 8-bit grey PNG under the SHA-256 of its samples, once for each
content.  A shard is a plain tar file in a shared folder; rows carry digest, shard, offset and
length.  Range reads of the first 33 bytes fill the metadata columns, and only what needs the
samples reads a whole member.

A task writes a shard of its own as it reads its rows, each content once, so payloads are never
shuffled and one text in a third of all rows costs one copy per task.  The index then keeps one
place for each digest, the first by shard and offset; what other shards hold of it is not
referred to.  A shard's name has the task attempt in it and its rows of the index are written by
that attempt, so what a lost one leaves is not referred to either.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import pack, shared_folder, unpack, written

#: Samples in a row of an image; a payload is a positive multiple of it.
WIDTH = 576
#: What a payload is filled up with.
FILL = b"\xff"
#: Bytes of a PNG file up to the end of its header chunk.
HEADER = 33


def payload_of(data: bytes) -> bytes:
    return data + FILL * (WIDTH if not data else -len(data) % WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    height = len(payload) // WIDTH
    lines = b"".join(b"\0" + payload[i : i + WIDTH] for i in range(0, len(payload), WIDTH))
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, 6)) + _chunk(b"IEND", b"")
    )


def png_header(start: bytes) -> tuple[int, int, int, int]:
    """(width, height, bits of a sample, colour type) from the first 33 bytes."""
    if start[:8] != b"\x89PNG\r\n\x1a\n" or start[12:16] != b"IHDR":
        raise ValueError("not a PNG file")
    return struct.unpack(">IIBB", start[16:26])


def from_png(media: bytes) -> bytes:
    width, height, bits, colour = png_header(media)
    if (bits, colour) != (8, 0):
        raise ValueError("only 8-bit grey images are stored here")
    at, packed = 8, []
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        if media[at + 4 : at + 8] == b"IDAT":
            packed.append(media[at + 8 : at + 8 + n])
        at += 12 + n
    lines = zlib.decompress(b"".join(packed))
    step = width + 1
    if len(lines) != step * height or any(lines[::step]):
        raise ValueError("unexpected image data")
    return b"".join(lines[i + 1 : i + step] for i in range(0, len(lines), step))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _bytes(batch):
    import pyarrow as pa

    return (t.as_py() for t in batch.column("text").cast(pa.binary()))


def _address(batches):
    """Each row's content address, without its bytes."""
    import pyarrow as pa

    for batch in batches:
        found = []
        for t in _bytes(batch):
            p = payload_of(t)
            found.append((len(t), len(p), hashlib.sha256(p).digest()))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                pa.array([x[0] for x in found], pa.int64()),
                pa.array([x[1] for x in found], pa.int64()),
                pa.array([x[2] for x in found], pa.binary()),
            ],
            names=["row", "n_bytes", "payload_bytes", "digest"],
        )


def _write_shard(folder: str):
    """(digest, shard, offset, length) of each content that the task meets for the first time."""

    def run(batches):
        import tarfile

        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        files, top = _filesystem(folder)
        shard = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}.tar"
        stream, at = None, 0
        sent: set[bytes] = set()
        for batch in batches:
            rows = []
            for t in _bytes(batch):
                p = payload_of(t)
                d = hashlib.sha256(p).digest()
                if d in sent:
                    continue
                sent.add(d)
                if stream is None:
                    files.create_dir(top, recursive=True)
                    stream = files.open_output_stream(f"{top}/{shard}")
                media = to_png(p)
                info = tarfile.TarInfo(d.hex() + ".png")
                info.size = len(media)
                stream.write(info.tobuf(tarfile.USTAR_FORMAT) + media + b"\0" * (-len(media) % 512))
                rows.append((d, at + 512, len(media)))
                at += 512 + len(media) + -len(media) % 512
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.binary()),
                    pa.array([shard] * len(rows), pa.string()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                ],
                names=["digest", "shard", "offset", "length"],
            )
        if stream is not None:
            stream.write(b"\0" * 1024)
            stream.close()

    return run


def _ranges(folder: str, batches, most: int | None):
    """For each batch, the first `most` bytes of each of its rows' members."""
    files, top = _filesystem(folder)
    opened = name = None
    for batch in batches:
        found = []
        places = zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True)
        for shard, offset, length in places:
            if shard != name:
                opened and opened.close()
                opened, name = files.open_input_file(f"{top}/{shard}"), shard
            found.append(opened.read_at(min(length, most or length), offset))
        yield batch, found
    opened and opened.close()


def _fill(folder: str):
    def run(batches):
        import pyarrow as pa

        for batch, starts in _ranges(folder, batches, HEADER):
            heads = [png_header(s) for s in starts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array([h[i] for h in heads], pa.int64()) for i in range(4)]],
                names=[*batch.schema.names, "width", "height", "bits", "colour"],
            )

    return run


def _feature(samples: bytes, width: int) -> str:
    """Mean, spread, mean step along the rows, and a 16-bin histogram of the samples."""
    import numpy as np

    x = np.frombuffer(samples, np.uint8).reshape(-1, width).astype(np.int64)
    n, total = x.size, int(x.sum())
    spread = int((x * x).sum()) * n - total * total
    step = int(np.abs(np.diff(x, axis=1)).sum())
    bins = np.bincount(x.ravel() >> 4, minlength=16).tolist()
    return f"mean={total / n:.4f};var={spread / (n * n):.4f};step={step / (n - len(x)):.4f};hist={'.'.join(map(str, bins))}"


def _read(folder: str):
    def run(batches):
        import pyarrow as pa

        small = (s.slice(i, 64) for s in batches for i in range(0, s.num_rows, 64))
        for batch, media in _ranges(folder, small, None):
            out = []
            for m, width, height in zip(media, batch.column("width").to_pylist(), batch.column("height").to_pylist(), strict=True):
                p = from_png(m)
                out.append(
                    (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), hashlib.sha256(m).hexdigest(), f"png {width}x{height};{_feature(p, width)}")
                )
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([o[0] for o in out], pa.string()),
                    pa.array([o[1] for o in out], pa.int64()),
                    pa.array([o[2] for o in out], pa.string()),
                    pa.array([o[3] for o in out], pa.string()),
                ],
                names=[*batch.schema.names, "payload_sha256", "tail_crc32", "media_sha256", "feature"],
            )

    return run


def _with_longs(schema: StructType, *names: str) -> StructType:
    return StructType([*schema.fields, *[StructField(c, LongType()) for c in names]])


def store(packed: DataFrame, folder: str) -> DataFrame:
    """Writes the tar shards; (digest, shard, offset, length) of each content."""
    members = packed.select("text").mapInArrow(
        _write_shard(folder), "digest binary, shard string, offset long, length long"
    )
    place = F.min(F.struct("shard", "offset", "length")).alias("place")
    found = written(members, "media-index").groupBy("digest").agg(place)
    return found.select("digest", "place.shard", "place.offset", "place.length")


def by_shard(index: DataFrame) -> DataFrame:
    """The rows of a shard in one task, in the order of their places."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.repartition(n, "shard").sortWithinPartitions("shard", "offset")


def fill_metadata(index: DataFrame, folder: str) -> DataFrame:
    """index with width, height, bits and colour, from range reads of the members' headers."""
    schema = _with_longs(index.schema, "width", "height", "bits", "colour")
    return index.mapInArrow(_fill(folder), schema)


def read_features(index: DataFrame, folder: str) -> DataFrame:
    """A filled index with payload_sha256, tail_crc32, media_sha256 and feature of the samples
    as read back."""
    schema = StructType(list(index.schema.fields))
    for f in ("payload_sha256", "tail_crc32", "media_sha256", "feature"):
        schema = schema.add(f, LongType() if f == "tail_crc32" else StringType())
    return index.mapInArrow(_read(folder), schema)


def media_columns(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None
) -> DataFrame:
    """docs without the text, with n_bytes, payload_bytes, digest, shard, offset, length, width,
    height, bits, colour, payload_sha256, tail_crc32, media_sha256 and feature.

    A text's bytes are filled up to a positive multiple of 576 with bytes 255 and stored as a
    grey image 576 samples wide.  folder: where the shards go, a new shared folder if not given.

    A null text is an empty one: one row of bytes 255.  Equal texts share one member and all
    values; so do a text and a longer one that differ in trailing bytes 255 only, which UTF-8
    doesn't have.  A null id passes through; an empty table gives an empty table and no shard.
    """
    folder = folder or shared_folder(docs.sparkSession, "media")
    packed = pack(docs, id_col, text_col)
    index = store(packed, folder)
    members = written(read_features(fill_metadata(by_shard(index), folder), folder), "media-members")
    out = StructType().add("row", packed.schema["row"].dataType)
    out = _with_longs(out, "n_bytes", "payload_bytes").add("digest", "binary")
    rows = packed.select("row", "text").mapInArrow(_address, out)
    new = [c for c in out.fieldNames() if c != "row"] + [c for c in members.columns if c != "digest"]
    return unpack(rows.join(members, "digest", "left"), docs.drop(text_col), text_col, {c: F.col(c) for c in new})
