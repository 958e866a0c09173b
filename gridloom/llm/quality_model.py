"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer
network with temperature-calibrated probabilities.

Each token has a hash slot, and each slot a fixed ternary index vector.  A slot's context vector
is the sum of its words' neighbours' index vectors over the sample, in whole numbers, so that it
doesn't depend on the order of adding; a word's vector is both, at unit length.  Every word of
the sample counts and none is listed, so the model's size is fixed.  A document is the mean of its tokens' vectors, with a few figures of its shape.  The
network is trained on the driver on the sample's pooled vectors only; a part of the sample that
it doesn't train on sets the temperature.

Learned from a bounded sample of labelled rows; every text is pooled whole.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import pack, unpack
from .labelled import sample, sampled_texts

#: Letters, digits, signs, and line ends.
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n").findall
DIM, SLOTS, REACH, HIDDEN = 64, 1 << 15, 2, 32
#: Entries of an index vector that aren't zero.
SET = 8
#: Figures of a document's shape beside its pooled vector.
SHAPE = 8
#: Tokens that a task remembers the vector of.
REMEMBERED = 200_000


def index_vectors():
    """A ternary vector for each hash slot; the last row marks tokens in capitals."""
    import numpy as np

    rng = np.random.default_rng(11)
    spots = rng.random((SLOTS + 1, DIM)).argsort(1)[:, :SET]
    out = np.zeros((SLOTS + 1, DIM), np.int32)
    np.put_along_axis(out, spots, rng.choice(np.array([-1, 1], np.int32), spots.shape), 1)
    return out


def slot(token: str) -> int:
    return zlib.crc32(token.encode()) % SLOTS


class _Rows(dict):
    """Row of the vector table for a token, found once.  Capitals have the table's second half."""

    def __missing__(self, token: str) -> int:
        at = slot(token.lower()) + SLOTS * (len(token) > 1 and token.isupper())
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = at
        return at


def pooled(text: str, rows: _Rows, vectors):
    """The features of a text."""
    import numpy as np

    tokens = TOKEN(text)
    n = len(tokens)
    out = np.zeros(DIM + SHAPE, np.float32)
    if not n:
        return out
    at = np.fromiter(map(rows.__getitem__, tokens), np.int64, n)
    total = np.zeros(DIM, np.float64)
    for lo in range(0, n, 1 << 16):
        total += vectors[at[lo : lo + (1 << 16)]].sum(0, dtype=np.float64)
    out[:DIM] = total / n
    lines = text.split("\n")
    triples = at[:-2] * 1_000_003 + at[1:-1] * 1_009 + at[2:] if n > 2 else at
    counts = np.unique(at, return_counts=True)[1]
    out[DIM:] = (
        np.log1p(n) / 10,
        len(counts) / n,
        counts.max() / n,
        (at[1:] == at[:-1]).mean() if n > 1 else 0.0,
        len(np.unique(triples)) / len(triples),
        len(text) / n / 10,
        len(set(lines)) / len(lines),
        sum(map(len, tokens)) / max(1, len(text)),
    )
    return out


def _contexts(batches):
    """(slot, vector): sums over the task's texts."""
    import numpy as np
    import pyarrow as pa

    index, slots = index_vectors(), _Rows()
    sums = np.zeros((SLOTS, DIM), np.int64)
    for batch in batches:
        for t in batch.column("text"):
            tokens = TOKEN(t.as_py().lower())
            # a part at a time; what it borders on is in both
            for lo in range(0, len(tokens), 1 << 16):
                first, end = max(0, lo - REACH), min(len(tokens), lo + (1 << 16))
                own = np.fromiter(map(slots.__getitem__, tokens[first : end + REACH]), np.int64)
                vectors = index[own]
                near = np.zeros_like(vectors)
                for d in range(1, REACH + 1):
                    near[d:] += vectors[:-d]
                    near[:-d] += vectors[d:]
                np.add.at(sums, own[lo - first : end - first], near[lo - first : end - first])
    used = np.flatnonzero(sums.any(1))
    for lo in range(0, len(used), 8192):
        part = used[lo : lo + 8192]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array([v.tobytes() for v in sums[part]], pa.binary())],
            names=["slot", "vector"],
        )


def _add(table):
    import numpy as np
    import pyarrow as pa

    at = table.column("slot").to_numpy()
    own, to = np.unique(at, return_inverse=True)
    sums = np.zeros((len(own), DIM), np.int64)
    np.add.at(sums, to, np.frombuffer(b"".join(table.column("vector").to_pylist()), np.int64).reshape(-1, DIM))
    return pa.table({"slot": pa.array(own, pa.int32()), "vector": pa.array([v.tobytes() for v in sums], pa.binary())})


def word_vectors(texts: DataFrame):
    """A vector for each slot, for small letters and then for capitals."""
    import numpy as np

    summed = (
        texts.select("text")
        .mapInArrow(_contexts, "slot int, vector binary")
        .groupBy(F.pmod("slot", F.lit(64)))
        .applyInArrow(_add, "slot int, vector binary")
    )
    index = index_vectors().astype(np.float64)
    contexts = np.zeros((SLOTS, DIM))
    for r in summed.collect():  # a row for each slot at most
        contexts[r.slot] = np.frombuffer(r.vector, np.int64)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    plain = unit(unit(contexts) + unit(index[:SLOTS]))
    capital = (plain + index[SLOTS] / np.sqrt(SET)) / np.sqrt(2)
    return np.concatenate((plain, capital)).astype(np.float32)


def _pool(pooling):
    def run(batches):
        import pyarrow as pa

        vectors, rows = pooling.value, _Rows()
        for batch in batches:
            out = [pooled(t.as_py(), rows, vectors).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(out, pa.binary())],
                names=["id", "label", "x"],
            )

    return run


@dataclass
class Network:
    mean: object
    spread: object
    w1: object
    b1: object
    w2: object
    b2: float
    temperature: float

    def probability(self, x):
        import numpy as np

        # without BLAS, whose sums depend on how many rows come at once
        h = np.maximum(np.einsum("ij,jk->ik", (x - self.mean) / self.spread, self.w1) + self.b1, 0)
        z = (np.einsum("ij,j->i", h, self.w2) + self.b2) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_network(x, y, epochs: int = 60, seed: int = 5) -> Network:
    """Adam on the log loss; every fifth row is kept for the temperature."""
    import numpy as np

    x = x.astype(np.float64)
    d = x.shape[1]
    if len(set(y.tolist())) < 2:  # nothing to tell apart: the share of label 1, with one more of each
        share = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    mean, spread = x.mean(0), x.std(0) + 1e-3
    x = np.clip((x - mean) / spread, -8, 8)
    rng = np.random.default_rng(seed)
    held = np.arange(len(x)) % 5 == 4
    if held.sum() < 20 or len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(x), bool)
    tx, ty = x[~held], y[~held]
    p = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        order = rng.permutation(len(tx))
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        for lo in range(0, len(order), 128):
            bx, by = tx[order[lo : lo + 128]], ty[order[lo : lo + 128]]
            h = np.maximum(bx @ p[0] + p[1], 0)
            out = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30)))
            g = (out - by) / len(by)
            gh = np.outer(g, p[2]) * (h > 0)
            grads = [bx.T @ gh + 1e-4 * p[0], gh.sum(0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
            t += 1
            for i, gr in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * gr
                v[i] = 0.999 * v[i] + 0.001 * gr * gr
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, spread, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if held.any():
        z = np.maximum(x[held] @ p[0] + p[1], 0) @ p[2] + p[3]
        hy = y[held]
        loss = lambda temp: float(np.mean(np.logaddexp(0, -(2 * hy - 1) * z / temp)))
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def _score(pooling, network):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        vectors, rows = pooling.value, _Rows()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                x = np.stack([pooled(t.as_py(), rows, vectors) for t in part.column("text")])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("text"), pa.array(network.probability(x), pa.float64())],
                    names=["row", "text", "score"],
                )

    return run


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    train=None,
    most: int = 8_000,
) -> DataFrame:
    """docs with score, the probability of label 1.

    train: which rows of labels to learn from, all if not given; most: rows of each label at
    most that the sample takes.  Other columns than the text play no part in a score.

    A null text is an empty one and comes back so; an empty text has features of zero and a score like any other.
    Without labels of both kinds all scores are the share of label 1.  Each row is scored; equal
    texts get equal scores; an empty table gives an empty one.
    """
    import numpy as np

    spark = docs.sparkSession
    packed = pack(docs, id_col, text_col)
    chosen = sample(labels, id_col, label_col, F.lit(True) if train is None else train, most)
    texts = sampled_texts(packed, chosen).cache()
    pooling = spark.sparkContext.broadcast(word_vectors(texts))  # of a fixed size
    seen = texts.select("id", "label", "text").mapInArrow(_pool(pooling), "id long, label int, x binary").toPandas()
    texts.unpersist()
    seen = seen.sort_values(["id", "x"], kind="stable")
    x = np.frombuffer(b"".join(seen.x), np.float32).reshape(-1, DIM + SHAPE)
    network = train_network(x, seen.label.to_numpy(float))
    out = StructType().add("row", packed.schema["row"].dataType).add("text", StringType())
    done = packed.select("row", "text").mapInArrow(_score(pooling, network), out.add("score", DoubleType()))
    return unpack(done, docs, text_col, {"score": F.col("score")})

