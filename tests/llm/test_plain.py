"""Models, mixes and links against plain versions that share no code with them."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe, common, media_columns, quality_model, secret_scan, simhash, source_mix, substring_dedup, toxicity
from gridloom.llm.queries import tokenizer

from . import brute

LETTERS = ("ka", "lo", "mi", "re", "tu", "sa")
VOCABULARY = [f"{a}{b}" for a in LETTERS for b in ("n", "ra", "so", "vi", "zel")]


def _labelled(spark, n=500, seed=8):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(VOCABULARY) for _ in range(rng.randrange(30, 120))]
        if i % 4 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vilefoo", "vilebar", "Vilebaz", "kanu"]))
        if i % 5 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 != 0), int(i % 4 == 0)))
    rows += [(1000 + i, rows[4][1]) for i in range(6)] + [(2000, None), (2001, "")]
    labels += [(1000 + i, 1, 1) for i in range(6)] + [(2000, 1, 0)]
    return rows, labels, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def plain_toxicity(rows, labels):
    """Scores of all rows, learned from all labels."""
    text_of = {i: t or "" for i, t in rows}
    given = {i: y for i, _, y in labels}
    ids = sorted(given)
    unit, tokens = 4096, lambda t: re.findall(r"[^\W_]+", t.lower())

    def values(t):
        w = t.lower().split()
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))]
        out = []
        for k in range(4):
            x = [(v * (2 * k + 0x9E3779B97F4A7C15)) % 2**64 for v in h]
            out.append(min(v ^ (v >> 29) for v in x))
        return out

    sketches = {i: values(text_of[i]) for i in ids}
    groups = Counter((k, sketches[i][k]) for i in ids for k in range(4))
    weight = {i: max(1, unit // sorted(groups[k, sketches[i][k]] for k in range(4))[-2]) for i in ids}
    fold = {i: sketches[i][0] & 1 for i in ids}

    def learn(own):
        counts = defaultdict(lambda: [0, 0])
        for i in own:
            for t, n in Counter(tokens(text_of[i])).items():
                for term in [t[:k] for k in range(1, min(len(t), 12) + 1)] + [t + "$"]:
                    counts[term][1 - given[i]] += round(weight[i] * math.log2(1 + n))
        counts = {t: (a / unit, b / unit) for t, (a, b) in counts.items() if a + b}
        nt, nc = (sum(c[i] for t, c in counts.items() if t[-1] == "$") for i in (0, 1))
        share, level = nt / (nt + nc), 2 * math.log(len(counts))

        def deviance(c, p):
            return 2 * sum(y * math.log(y / (sum(c) * q)) for y, q in zip(c, (p, 1 - p), strict=True) if y)

        score = {}
        for t, c in counts.items():
            a, b = c[0] + share, c[1] + 1 - share
            s = math.log(a / (nt + 1)) - math.log(b / (nc + 1)) - math.sqrt(1 / a + 1 / b)
            if c[0] > share * sum(c) and deviance(c, share) > level and s > math.log(2):
                score[t] = s
        post = lambda c: (c[0] + share) / (sum(c) + 1)
        for t, c in counts.items():
            if t not in score and any(
                t[:k] in score and post(c) < (p := post(counts[t[:k]])) and deviance(c, p) > 3.84 for k in range(1, min(len(t) - 1, 12) + 1)
            ):
                score[t] = 0.0

        def of(word):
            return next((score[x] for x in [word + "$"] + [word[:k] for k in range(min(12, len(word)), 0, -1)] if x in score), 0.0)

        longest = lambda t: next((score[t[:k]] for k in range(min(len(t) - 1, 12), 0, -1) if t[:k] in score), 0.0)
        kept = [t for t in score if score[t] or longest(t)]
        parts = [((counts[t][1] + 0.5) / (nc + 1), score[t]) for t in kept]
        rest = max(0.0, 1 - sum(p for p, _ in parts))
        low, high = 1e-3, 5.0
        for _ in range(60):
            mid = (low + high) / 2
            if sum(p * math.exp(mid * s) for p, s in parts) + rest * math.exp(-mid * 0.1) < 1:
                low = mid
            else:
                high = mid
        return of, low

    def segments(t, of):
        x = [s if (s := of(w)) else -0.1 for w in tokens(t)]

        def inside(a, b):
            total = [0.0]
            for v in x[a:b]:
                total.append(total[-1] + v)
            best = max(((total[q] - total[p], -p, -q) for p in range(len(total)) for q in range(p + 1, len(total)) if x[a + p] > 0 and x[a + q - 1] > 0), default=None)
            if best is None or best[0] <= 0:
                return []
            return inside(a, a - best[1]) + [best[0]] + inside(a - best[2], b)

        return len(x), inside(0, len(x))

    halves = [learn([i for i in ids if fold[i] != f]) for f in (0, 1)]
    whole, lam = learn(ids)
    seen = {i: segments(text_of[i], halves[fold[i]][0]) for i in ids}
    chance = [(halves[fold[i]][1] * max(seen[i][1], default=0) - math.log(seen[i][0]), weight[i]) for i in ids if not given[i] and seen[i][0]]
    k = math.exp(sum(v * w for v, w in chance) / sum(w for _, w in chance) - 0.5772156649)
    k = min(max(k, 1e-6), 10.0)

    def shape(n, found, lam):
        gains = [lam * s - math.log(k * n) for s in found]
        return 1.0, math.tanh(max(gains, default=0) / 10) * 10, math.log1p(sum(g for g in gains if g > 3))

    x = np.array([shape(*seen[i], halves[fold[i]][1]) for i in ids])
    y = np.array([given[i] for i in ids], float)
    b = np.zeros(3)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (p - y) + 0.05 * b)
    return {i: 1 / (1 + math.exp(-max(-30, min(30, float(np.dot(b, shape(*segments(text_of[i], whole), lam))))))) for i, _ in rows}


def test_toxicity_is_the_plain_model(spark):
    rows, labels, docs, known = _labelled(spark, 160)
    want = plain_toxicity(rows, labels)
    for parts in (2, 5):
        got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs.repartition(parts), known).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_copies_do_not_make_a_term_toxic(spark):
    """A toxic text in forty copies says no more of its words than one text."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(60))) for i in range(200)]
    copied = " ".join(f"own{j}" for j in range(60))
    rows += [(1000 + i, copied) for i in range(40)] + [(2000, "own3 own9 kanso " + rows[0][1])]
    labels = [(i, 1 if i >= 1000 else 0) for i, _ in rows if i < 2000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got[2000] < 0.5


def test_quality_scores_do_not_depend_on_partitions(spark):
    _, _, docs, labels = _labelled(spark, 300)
    found = [
        sorted((r.doc_id, r.score) for r in quality_model.score_quality(docs.repartition(n), labels).collect()) for n in (3, 7)
    ]
    assert found[0] == found[1]


def test_quality_vectors_and_network_are_the_plain_ones(spark):
    _, _, docs, _ = _labelled(spark, 20)
    index = quality_model.index_vectors()
    sums = np.zeros((quality_model.SLOTS, quality_model.DIM), np.int64)
    number = lambda t: zlib.crc32(t.encode()) % quality_model.SLOTS
    texts = [r.text or "" for r in docs.collect()]
    split = lambda t: re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n", t)
    for t in texts:
        w = split(t.lower())
        for i, x in enumerate(w):
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                if j != i:
                    sums[number(x)] += index[number(w[j])]
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    table = quality_model.word_vectors(docs.na.fill("", ["text"]))
    for t in VOCABULARY:
        want = unit(unit(sums[number(t)].astype(float)) + unit(index[number(t)].astype(float)))
        assert np.allclose(table[number(t)], want, atol=1e-6)
    text = "kan LORA kan\nmiso, kan"
    got = quality_model.pooled(text, quality_model._Rows(), table)
    rows = [number("kan"), number("lora") + quality_model.SLOTS, number("kan"), number("\n"), number("miso"), number(","), number("kan")]
    assert np.allclose(got[:64], np.mean([table[r] for r in rows], axis=0), atol=1e-6)
    assert np.allclose(got[64:68], [math.log1p(7) / 10, 5 / 7, 3 / 7, 0.0], atol=1e-6)
    net = quality_model.Network(np.zeros(2), np.ones(2), np.array([[1.0, -1.0], [0.0, 2.0]]), np.array([0.0, 1.0]), np.array([1.0, -2.0]), 0.5, 2.0)
    hidden = [max(0.0, 1.0), max(0.0, -1.0 + 2 * 0.25 + 1.0)]
    assert abs(net.probability(np.array([[1.0, 0.25]]))[0] - 1 / (1 + math.exp(-(hidden[0] - 2 * hidden[1] + 0.5) / 2))) < 1e-12


def test_bpe_joins_ordinary_words():
    import tiktoken

    path, pattern = tokenizer()
    ranks = byte_bpe.read_ranks(path)
    plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.ByteBpe(ranks, pattern)
    text = "The committee of representatives considered seventeen recommendations, naturally. " * 40
    assert bpe.encode(text) == plain.encode_ordinary(text)
    distinct = {p for p in bpe.pieces(text) if len(p.encode()) > byte_bpe.LEAF}
    assert bpe.joins >= len(distinct) == 6
    n, ids, decoded = bpe.reduce(bpe.pieces(text))
    assert n == len(bpe.encode(text)) and decoded.decode() == text and ids.count(b",") == n - 1


def test_mix_is_the_plain_schedule(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), ("a", "b", None)[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = source_mix.mix_sources(docs, block=16)
    placed = source_mix.taken(mix).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(brute.words(t))
    targets = dict(zip(("a", "b", None), source_mix.shares([sizes[s] for s in ("a", "b", None)], [5, 2, 1], 3), strict=True))
    for s in sizes:
        own = sorted((r for r in placed if r.row.source == s), key=lambda r: r.place)
        stream = [r.row.doc_id for r in own for _ in range(r.size)]
        want = round(targets[s])
        used = Counter(stream[k % len(stream)] for k in range(want))
        assert {r.row.doc_id: r.taken for r in own} == {r.row.doc_id: used[r.row.doc_id] for r in own}
        assert [r.place for r in own] == [sum(x.size for x in own[:k]) for k in range(len(own))]
    wanted = [-(-round(targets[s]) // 16) for s in ("a", "b", None)]
    n, edges, points = sum(wanted), [], []
    for k in range(len(wanted) - 1):
        edges.append((sum(wanted[: k + 1]) << 64) // n)
    seen = Counter()
    for slot in range(n):
        src = sum(edge <= slot * 0x9E3779B97F4A7C15 % 2**64 for edge in edges)
        points.append((slot, src, seen[src]))
        seen[src] += 1
    got = {tuple(r) for r in mix.slots.collect()}
    assert {p for p in points if p[2] < wanted[p[1]]} <= got and len(got) == n
    assert isinstance(targets["a"], Fraction)


def test_mixed_documents_keep_their_own_columns(spark):
    rows = [(1, "a b c", "s", k) for k in range(4)] + [(None, "a b c", "s", 9), (1, "other text here", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int")
    found = [Counter(tuple(r) for r in source_mix.mixed_documents(docs.repartition(n)).collect()) for n in (1, 5)]
    assert found[0] == found[1] == Counter(rows)


def test_media_features(spark):
    docs = spark.createDataFrame([(1, "abc " * 400), (2, None), (3, "é" * 288)], "doc_id long, text string")
    for r in media_columns.media_columns(docs).collect():
        p = brute.payload({1: "abc " * 400, 2: "", 3: "é" * 288}[r.doc_id])
        lines = [p[i : i + 576] for i in range(0, len(p), 576)]
        mean = sum(p) / len(p)
        spread = sum(v * v for v in p) / len(p) - mean * mean
        steps = [abs(b - a) for line in lines for a, b in zip(line, line[1:], strict=False)]
        bins = Counter(v // 16 for v in p)
        shape, m, v, s, h = r.feature.split(";")
        assert shape == f"png 576x{len(lines)}" and h == "hist=" + ".".join(str(bins[k]) for k in range(16))
        assert abs(float(m[5:]) - mean) < 1e-3 and abs(float(v[4:]) - spread) < 1e-3 and abs(float(s[5:]) - sum(steps) / len(steps)) < 1e-3


def test_added_secret_kinds():
    jwt = "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"
    forge = "ghp_" + "a1B2" * 9
    text = f"x -----BEGIN RSA PRIVATE KEY----- é {jwt} {forge} ghp_short eyJ.eyJ.x"
    want = [("pem", 2, 33), ("jwt", 36, 36 + len(jwt)), ("forge", 37 + len(jwt), 37 + len(jwt) + len(forge))]
    assert secret_scan.scan_text(text) == want


def test_a_hot_minimiser_is_split(spark, monkeypatch):
    """One six-word line in all texts with ever new neighbours."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(400)}"
    rows = []
    for i in range(300):
        text = [word() for _ in range(40)] + "all of this stands everywhere now".split() + [word() for _ in range(40)]
        rows.append((i, " ".join(text)))
    rows += [(400 + i, rows[i][1]) for i in range(0, 40, 3)] + [(500 + i, " ".join(rows[i][1].split()[20:70])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    least = Counter()
    for _, t in rows:
        _, _, _, m, strings = substring_dedup.cut([t.encode()], 35)
        for x, s in zip(m.tolist(), strings, strict=True):
            least[x] += len(s)
    heavy = sorted(x for x, n in least.items() if n > 4000)
    assert heavy
    monkeypatch.setattr(substring_dedup, "PART_OF", 1)
    monkeypatch.setattr(substring_dedup, "HEAVY", 4000)
    monkeypatch.setattr(substring_dedup, "BUCKET", 5000)
    packed = common.pack(docs, "doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    buckets, found = substring_dedup.spread_of(packed, 35)
    assert buckets > 20 and set(found) <= set(heavy) and found
    parts = Counter()
    for _, t in rows:
        _, _, _, m, strings = substring_dedup.cut([t.encode()], 35, np.array(found, np.uint64))
        for x, s in zip(m.tolist(), strings, strict=True):
            parts[x] += len(s)
    assert max(parts.values()) < max(least.values()) / 2
    got = substring_dedup.dedup_substrings(docs)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()) == sorted(brute.substring_dedup(rows, 35))


@pytest.mark.parametrize("tau", [1, 4])
def test_links_join_what_all_pairs_join(spark, tau):
    rng = random.Random(tau)
    prints = set()
    for _ in range(8):
        b = rng.getrandbits(64)
        for _ in range(40):
            x = b
            for bit in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << bit
            prints.add(x)
            b = x if rng.random() < 0.3 else b
    signed = sorted(p - 2**64 if p >= 2**63 else p for p in prints)
    lead = {p: p for p in signed}

    def find(p):
        while lead[p] != p:
            p = lead[p]
        return p

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= tau:
                x, y = sorted((find(a), find(b)))
                lead[y] = x
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), tau)
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= tau for r in links.collect())
    got = {r.vertex: r.root for r in simhash.components(links).collect()}
    assert {p: got.get(p, p) for p in signed} == {p: find(p) for p in signed}


def test_a_cloud_is_linked_without_its_pairs(spark):
    """Two thousand fingerprints two bits or less from one: two million pairs."""
    centre = 0x5A5A_1234_89AB_4DEF
    prints = {centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i + 1)} | {centre}
    prints = {p - 2**64 if p >= 2**63 else p for p in prints}
    links = simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp long")).cache()
    assert links.count() < 70 * len(prints)
    roots = simhash.components(links).collect()
    assert len(roots) == len(prints) and len({r.root for r in roots}) == 1


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session(), "x")
