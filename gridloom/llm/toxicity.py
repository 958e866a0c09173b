"""Toxicity by maximum-scoring segments.

A term is a word or, where words with a common beginning lean the same way, that beginning.  A
term's score is the log-odds of its tokens between toxic and clean texts under Dirichlet priors
(one occurrence, dealt by the classes' shares), less one standard error.  A term counts if its
deviance from the classes' shares is over 2 ln(terms), the level that the largest of so many
chance deviances hardly reaches at any size of vocabulary, and a beginning only if none of the
longer ones departs from it.  Near copies in the sample share the weight of one text, so they
can't make a term look sure.

Any other token costs a little.  A linear scan (Ruzzo and Tompa) finds all maximal segments of a
text.  The score of a chance segment in n tokens follows an extreme-value distribution, so a
segment's evidence is lambda * score - ln(K * n) (Karlin and Altschul), with lambda from the
clean tokens' scores and K from the clean texts' best segments.  The evidence of a text's
significant segments, its best and its sum, is calibrated to a probability; K and the
calibration are taken from texts that the terms they are scored by weren't learned from.

Learned from a bounded sample of labelled rows; every text is scanned whole.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, pack
from .labelled import labelled_rows, sample, sampled_texts

#: Scripts written without spaces: each of their characters is a token.
ALONE = "\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff"
TOKEN_PATTERN = re.compile(f"[{ALONE}]|[^\\W_{ALONE}]+")
TOKEN = TOKEN_PATTERN.findall
#: Letters of the longest beginning that may be a term; whole words of any length may.
LONGEST = 12
#: Deviance from which a longer term departs from a beginning, one in twenty by chance.
DEPARTS = 3.84
#: Marks a term that is a whole word; not in any token.
END = "$"
#: Counts are whole numbers of 1/UNIT, so that sums don't depend on their order.
UNIT = 4096
#: Smallest hashes of a text's SPAN-word shingles that tell near copies.
SKETCH, SPAN = 4, 5
#: Words whose score a task remembers.
REMEMBERED = 200_000
SEGMENTS = "array<struct<start: long, end: long, evidence: double>>"


class _Scores(dict):
    """A token's score, found once."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.reach = max((len(t) for t in terms if t[-1] != END), default=0)

    def __missing__(self, token: str) -> float:
        known = self.terms.get
        s = known(token + END)
        n = min(self.reach, len(token))
        while s is None and n:
            s = known(token[:n])
            n -= 1
        s = s or 0.0
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = s
        return s


@dataclass
class Segments:
    """What a scan needs.  terms: scores of the terms that count for toxicity; drift: the cost
    of any other token; lam, k: of the extreme-value distribution; weights: of the calibration."""

    terms: dict[str, float]
    drift: float = 0.1
    lam: float = 1.0
    k: float = 0.1
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments, (score, first token, last token), of a text whose token i
    scores s for each (i, s) of hits, and -drift elsewhere.  Linear in hits."""
    total, last = 0.0, -1
    left: list[float] = []  # sum before a candidate
    right: list[float] = []  # sum at its end
    span: list[tuple[int, int]] = []
    lower: list[int] = []  # the nearest earlier candidate with a smaller left sum
    for i, s in hits:
        total -= drift * (i - last - 1)
        a, b, first = total, total + s, i
        total, last = b, i
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= a:
                j = lower[j]
            if j < 0 or right[j] >= b:
                break
            a, first = left[j], span[j][0]
            del left[j:], right[j:], span[j:], lower[j:]
        left.append(a)
        right.append(b)
        span.append((first, i))
        lower.append(j)
    return [(b - a, x, y) for a, b, (x, y) in zip(left, right, span, strict=True)]


def scan(text: str, scores: _Scores, drift: float) -> tuple[int, list[tuple[float, int, int]]]:
    """(tokens, maximal segments) of a text."""
    tokens = TOKEN(text.lower())
    return len(tokens), segments([(i, s) for i, t in enumerate(tokens) if (s := scores[t])], drift)


def weigh(n: int, found: list[tuple[float, int, int]], lam: float, k: float):
    """(best, sum, significant segments) of a text of n tokens; sum over significant segments,
    each as (first token, last token, evidence)."""
    if not found:
        return 0.0, 0.0, []
    floor = math.log(max(k * n, 1e-9))
    gains = [lam * s - floor for s, _, _ in found]
    # a chance of about exp(-3)
    significant = [(x, y, g) for g, (_, x, y) in zip(gains, found, strict=True) if g > 3.0]
    return max(gains), sum(g for _, _, g in significant), significant


def passages(text: str, found: list[tuple[int, int, float]]) -> list[dict]:
    """Segments by their tokens, as weigh() gives them, by the characters of the text."""
    if not found:
        return []
    low = text.lower()
    at = [m.span() for m in TOKEN_PATTERN.finditer(low)]
    place = list(range(len(low) + 1))
    if len(low) != len(text):  # a few letters are longer in lower case
        place = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
    return [
        {"start": place[at[x][0]], "end": place[at[y][1] - 1] + 1, "evidence": g} for x, y, g in found
    ]


def features(best: float, total: float) -> tuple[float, float, float]:
    return 1.0, math.tanh(best / 10) * 10, math.log1p(max(total, 0.0))


def probability(best: float, total: float, weights: tuple[float, ...]) -> float:
    z = sum(w * x for w, x in zip(weights, features(best, total), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def sketch(text: str) -> list[int]:
    """For each of SKETCH hash functions the smallest hash of the text's shingles."""
    import numpy as np
    import xxhash

    words = text.lower().split()
    hashed = xxhash.xxh64_intdigest
    least = np.full(SKETCH, 2**64 - 1, np.uint64)
    turns = np.array([2 * i + 0x9E3779B97F4A7C15 for i in range(SKETCH)], np.uint64)
    n = max(1, len(words) - SPAN + 1)
    for lo in range(0, n, 1 << 14):
        h = np.fromiter((hashed(" ".join(words[i : i + SPAN])) for i in range(lo, min(n, lo + (1 << 14)))), np.uint64)
        mixed = h[:, None] * turns
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(0))
    return least.view(np.int64).tolist()


def _sketches(batches):
    import pyarrow as pa

    for batch in batches:
        found = [sketch(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("text_key"), pa.array(found, pa.list_(pa.int64()))],
            names=["id", "text_key", "sketch"],
        )


def weights_of(seen):
    """seen (a pandas frame with sketch) with weight, in 1/UNIT, and fold.

    A text's group has the texts that share a sketch value with it; of its values' groups the
    second largest counts, as one value alone may lie in a line that many texts have."""
    import numpy as np

    values = np.array(seen.sketch.tolist(), np.int64).reshape(-1, SKETCH)
    sizes = np.stack([np.unique(v, return_inverse=True, return_counts=True)[2][np.unique(v, return_inverse=True)[1]] for v in values.T], axis=1)
    group = np.sort(sizes, axis=1)[:, -2]
    return seen.assign(weight=np.maximum(1, UNIT // group), fold=(values[:, 0] & 1).astype(int))


def _counts(batches):
    """(term, t0, c0, t1, c1): uses of a word in toxic and clean texts of each fold.  A text's
    n uses of a word count log2(1 + n), times its weight; the empty term has all words' sums."""
    import pyarrow as pa

    found: dict[str, list[int]] = {}
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("label", "weight", "fold")]
        for text, label, weight, fold in zip(batch.column("text"), *columns, strict=True):
            own: dict[str, int] = {}
            for t in TOKEN(text.as_py().lower()):
                own[t] = own.get(t, 0) + 1
            at = 2 * fold + 1 - label
            for t, n in own.items():
                found.setdefault(t, [0, 0, 0, 0])[at] += round(weight * math.log2(1 + n))
    names = list(found)
    for lo in range(0, len(names), 50_000):
        part = names[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.string()), *[pa.array([found[t][i] for t in part], pa.int64()) for i in range(4)]],
            names=["term", "t0", "c0", "t1", "c1"],
        )


def _terms(nodes: DataFrame, toxic: Column, clean: Column, least: float) -> tuple[list, float, float]:
    """(rows (term, score, yc), tokens of toxic, of clean texts) of the terms that count, and, with
    a score of 0, of those that depart from a beginning that counts."""
    counted = nodes.select("term", (toxic / UNIT).alias("yt"), (clean / UNIT).alias("yc")).where("yt + yc > 0")
    word = F.col("term").endswith(END)
    whole = counted.agg(
        F.sum(F.when(word, F.col("yt"))), F.sum(F.when(word, F.col("yc"))), F.count("*")
    ).first()
    nt, nc, size = whole[0] or 0.0, whole[1] or 0.0, whole[2]
    if not nt or not nc:
        return [], nt, nc
    share, level = nt / (nt + nc), 2 * math.log(size)
    part = lambda y, p: F.when(y > 0, y * F.log(y / ((F.col("yt") + F.col("yc")) * p))).otherwise(0.0)
    deviance = lambda p: 2 * (part(F.col("yt"), p) + part(F.col("yc"), 1 - p))
    at, ac = share, 1 - share
    delta = F.log((F.col("yt") + at) / (nt + 1)) - F.log((F.col("yc") + ac) / (nc + 1))
    error = F.sqrt(1 / (F.col("yt") + at) + 1 / (F.col("yc") + ac))
    lean = F.col("yt") > share * (F.col("yt") + F.col("yc"))
    shown = counted.withColumn("score", delta - error).withColumn("p", (F.col("yt") + at) / (F.col("yt") + F.col("yc") + 1))
    some = shown.where(lean & (deviance(F.lit(share)) > level) & (F.col("score") > least))
    leads = F.broadcast(some.where(~word).select(F.col("term").alias("lead"), F.col("p").alias("lead_p")))
    begins = F.expr(f"transform(sequence(1, least(length(term) - 1, {LONGEST})), n -> left(term, n))")
    lower = (F.col("p") < F.col("lead_p")) & (deviance(F.col("lead_p")) > DEPARTS)
    below = shown.where(F.length("term") > 1).withColumn("lead", F.explode(begins)).join(leads, "lead").where(lower)
    plain = below.select("term", F.lit(0.0).alias("score"), "yc").distinct()
    rows = {r.term: r for r in plain.collect()} | {r.term: r for r in some.select("term", "score", "yc").collect()}
    # what says the same as the longest beginning that counts needn't be held
    kept = []
    for t in sorted(rows):
        up = next((rows[t[:n]] for n in range(min(len(t) - 1, LONGEST), 0, -1) if t[:n] in rows), None)
        if rows[t].score or up and up.score:
            kept.append(rows[t])
    return kept, nt, nc


def _model(found: tuple[list, float, float], drift: float) -> Segments:
    """lambda: the clean tokens' mean of exp(lambda * score) is one."""
    import numpy as np

    rows, _, nc = found
    share = np.array([(r.yc + 0.5) / (nc + 1) for r in rows] or [0.0])
    score = np.array([r.score for r in rows] or [0.0])
    rest = max(0.0, 1 - share.sum())
    low, high = 1e-3, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        if (share * np.exp(mid * score)).sum() + rest * math.exp(-mid * drift) < 1:
            low = mid
        else:
            high = mid
    return Segments({r.term: r.score for r in rows}, drift, low)


def _raw(models):
    """(id, label, n, scores): of each text, by the model of the fold it isn't in."""

    def run(batches):
        import pyarrow as pa

        scores = [_Scores(terms) for terms, _ in models]
        for batch in batches:
            found = [
                scan(t.as_py(), scores[f], models[f][1])
                for t, f in zip(batch.column("text"), batch.column("fold").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("id", "text_key", "label", "weight", "fold")],
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([[s for s, _, _ in own] for _, own in found], pa.list_(pa.float64())),
                ],
                names=["id", "text_key", "label", "weight", "fold", "n", "scores"],
            )

    return run


def _logistic(x, y, w, rounds: int = 50):
    """Coefficients by Newton's method with a small ridge; w: the rows' weights."""
    import numpy as np

    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (p - y)) + 0.05 * b
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(texts: DataFrame, labelled: dict[int, int], drift: float = 0.1, least: float = math.log(2)) -> Segments:
    """A model from (id, text_key, text, label) rows.

    labelled: rows of each label that the sample is from, whose shares the probabilities keep to;
    drift: the cost of a token without a score; least: the least score of a term.  Without texts of both labels every text gets the
    share of toxic ones, with one more of each.
    """
    import numpy as np

    spark = texts.sparkSession
    docs = {r.label: r["count"] for r in texts.groupBy("label").count().collect()}
    if not docs.get(1) or not docs.get(0):
        share = [labelled.get(v, 0) if docs.get(v) else 0 for v in (0, 1)]
        return Segments({}, weights=(math.log((share[1] + 1) / (share[0] + 1)), 0.0, 0.0))
    seen = texts.mapInArrow(_sketches, "id long, text_key long, sketch array<long>").toPandas()
    seen = weights_of(seen.drop_duplicates(["id", "text_key"]))
    known = spark.createDataFrame(
        list(zip(*(seen[c].tolist() for c in ("id", "text_key", "weight", "fold")), strict=True)),
        "id long, text_key long, weight long, fold int",
    )
    texts = texts.join(F.broadcast(known), ["id", "text_key"])  # a row for each of the sample's
    words = (
        texts.mapInArrow(_counts, "term string, t0 long, c0 long, t1 long, c1 long")
        .groupBy("term")
        .agg(*[F.sum(c).alias(c) for c in ("t0", "c0", "t1", "c1")])
    )
    begins = F.expr(f"transform(sequence(1, least(length(term), {LONGEST})), n -> left(term, n))")
    nodes = (
        words.withColumn("term", F.explode(F.array_append(begins, F.concat("term", F.lit(END)))))
        .groupBy("term")
        .agg(*[F.sum(c).alias(c) for c in ("t0", "c0", "t1", "c1")])
        .cache()
    )
    c = F.col
    # a text of fold 0 is scored by what fold 1 holds
    halves = [_model(_terms(nodes, c("t1"), c("c1"), least), drift), _model(_terms(nodes, c("t0"), c("c0"), least), drift)]
    model = _model(_terms(nodes, c("t0") + c("t1"), c("c0") + c("c1"), least), drift)
    nodes.unpersist()
    shown = "id long, text_key long, label int, weight long, fold int, n long, scores array<double>"
    plain = [(m.terms, m.drift) for m in halves]
    got = texts.mapInArrow(_raw(plain), shown).toPandas().sort_values(["id", "text_key"], kind="stable")
    lam = np.array([m.lam for m in halves])[got.fold]
    best = np.array([max(s, default=0.0) for s in got.scores])
    chance = ((got.label == 0) & (got.n > 0)).to_numpy()
    if chance.any():
        # a Gumbel mean is ln(K n) + Euler's number
        excess = lam[chance] * best[chance] - np.log(got.n[chance])
        model.k = float(np.exp(np.average(excess, weights=got.weight[chance]) - 0.5772156649))
        model.k = min(max(model.k, 1e-6), 10.0)
    x = np.array(
        [features(*weigh(n, [(s, 0, 0) for s in own], m, model.k)[:2]) for n, own, m in zip(got.n, got.scores, lam, strict=True)]
    )
    y = got.label.to_numpy(float)
    of_label = np.array([labelled.get(v, 0) / max(1, docs[v]) for v in (0, 1)])
    model.weights = tuple(float(v) for v in _logistic(x, y, of_label[got.label.to_numpy(int)]))
    return model


def _score(model):
    def run(batches):
        import pyarrow as pa

        known = Segments(**model.value)
        scores = _Scores(known.terms)
        parts = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())])
        for batch in batches:
            out, spans = [], []
            for t in batch.column("text"):
                text = t.as_py()
                best, total, found = weigh(*scan(text, scores, known.drift), known.lam, known.k)
                out.append(probability(best, total, known.weights))
                spans.append(passages(text, found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(out, pa.float64()), pa.array(spans, pa.list_(parts))],
                names=["id", "score", "segments"],
            )

    return run


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    train=None,
    most: int = 20_000,
) -> DataFrame:
    """(id_col, score, segments) of each row of docs; score is the probability of label 1.

    segments: the text's significant segments (start, end, evidence) in their order, by characters
    of the text from 0, end exclusive; empty where nothing is significant.

    train: which rows of labels to learn from, all if not given; most: rows of each label at
    most that the sample takes.  Other columns than the text play no part in a score.

    A null text is an empty one and is scored like any text without toxic tokens.  Each row is
    scored, with a null id too; equal texts get equal scores; an empty table gives an empty one.
    """
    packed = pack(docs, id_col, text_col).select("id", "text")
    rows = F.lit(True) if train is None else train
    chosen = sample(labels, id_col, label_col, rows, most)
    labelled = {r.label: r["count"] for r in labelled_rows(labels, id_col, label_col, rows).groupBy("label").count().collect()}
    texts = sampled_texts(packed, chosen).withColumn("text_key", F.xxhash64("text")).cache()
    # a term for each that stands out of the sample; plain values, as workers need not know this package's classes
    model = docs.sparkSession.sparkContext.broadcast(vars(fit(texts, labelled)))
    texts.unpersist()
    return packed.mapInArrow(_score(model), f"id long, score double, segments {SEGMENTS}").select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "score", "segments"
    )
