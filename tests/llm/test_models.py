import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparkloom.llm import ctw, langid, quality
from sparkloom.llm.common import fold

SMALL = "/root/testdata/sf0.01"
EDGE = "doc_id long, text string, lang string, score double, label string"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")


def odd(spark):
    return spark.createDataFrame([(-1, None, "en", 0.0, "x"), (-2, "", None, 0.0, "x"), (-3, "123 !!", "de", 0.0, "x"), (-4, "a" * 300_000, "en", 0.0, "x"), (-5, "\n\n", "fr", 0.0, "x")], EDGE)


def test_quality_held_out(spark, tables):
    docs, labels = tables
    found = quality.measured(docs)
    model = quality.fit(found, labels)
    both = quality.scores(found, model).join(labels, "doc_id").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2).collect()
    right = sum((r.score >= 0.7) == (r.quality == 1) for r in both)
    assert right >= 0.95 * len(both)
    rows = quality.scores(quality.measured(odd(spark)), model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_sums_equal_one_pass(spark, tables):
    docs, labels = tables
    rows = docs.join(labels.withColumn("label", F.col("quality").cast("long")), "doc_id").limit(60).select("doc_id", "text", "label").persist()
    got = quality.moments(quality.measured(rows.repartition(5)).join(rows.select("doc_id", "label"), "doc_id"))
    import pyarrow as pa

    local = rows.collect()
    x = np.vstack([quality.statistics(pa.array([r.text])) for r in local])
    for label, (n, s, ss) in got.items():
        mine = x[[r.label == label for r in local]]
        assert n == len(mine) and np.allclose(s, mine.sum(0)) and np.allclose(ss, mine.T @ mine)


def test_quality_without_labels(spark, tables):
    none = spark.createDataFrame([], "doc_id long, quality int")
    found = quality.measured(tables[0].limit(5))
    assert {r.score for r in quality.scores(found, quality.fit(found, none)).collect()} == {0.5}


def test_language_held_out(spark, tables):
    docs = tables[0]
    net = langid.fit(docs, sample=2400)
    got = langid.predictions(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    rows = {r.doc_id: r for r in langid.predictions(odd(spark), net).collect()}
    assert {i: rows[i].lang_pred for i in (-1, -2, -3, -5)} == dict.fromkeys((-1, -2, -3, -5), "und")
    assert rows[-1].score == 0 and 0 < rows[-4].score <= 1


def test_language_with_nothing_to_learn(spark):
    docs = odd(spark).withColumn("lang", F.lit(None).cast("string"))
    assert langid.fit(docs) is None
    assert {r.lang_pred for r in langid.predictions(docs, None).collect()} == {"und"}


def test_gradient_of_the_network():
    rng = np.random.default_rng(1)
    net = langid.Network(["a", "b"], hidden=3, seed=2)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    cells, length, label = rng.integers(0, 256, (6, 5)).astype(np.uint8), np.array([6, 6, 3, 1, 5]), np.array([0, 1, 1, 0, 1])

    def loss():
        p = 0.0
        f, b = net.states(cells, length, "f"), net.states(cells, length, "b")
        for i in range(6):
            logit = net.w["of"] @ f[i] + net.w["ob"] @ b[i] + net.w["c"]
            q = np.exp(logit) / np.exp(logit).sum(0)
            p -= (np.log(q[label, range(5)]) * (i < length)).sum()
        return p / length.sum()

    before = {k: v.copy() for k, v in net.w.items()}
    moments = {}
    net.step(cells, length, label, moments, 0.0)
    for k in net.w:
        grad = moments[k][0] / 0.1
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        net.w = {n: v.copy() for n, v in before.items()}
        net.w[k][at] += 1e-3
        high = loss()
        net.w[k][at] -= 2e-3
        assert abs((high - loss()) / 2e-3 - grad[at]) < 1e-3 * max(1, abs(grad[at]))


WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def huffman(counts):
    """The decisions (inner node, side) of every symbol, by merging the two lightest trees until one is left."""
    trees = [(n + 1, i, i) for i, n in enumerate(counts)]
    made = len(counts)
    while len(trees) > 1:
        trees.sort()
        (a, _, x), (b, _, y) = trees[:2]
        trees = [*trees[2:], (a + b, made, (made, x, y))]
        made += 1
    ways = {}

    def walk(tree, way):
        if isinstance(tree, int):
            ways[tree] = way
        else:
            number, x, y = tree
            walk(x, [*way, (number, 0)])
            walk(y, [*way, (number, 1)])

    walk(trees[0][2], [])
    return ways


def brute_ctw(texts, depth):
    symbols = {i: (256,) * depth + tuple((t or "").encode()) + (256,) for i, t in texts.items()}
    grams = {i: [s[k - depth : k + 1] for k in range(depth, len(s))] for i, s in symbols.items()}
    learn = {i for i in texts if zlib.crc32(str(i).encode()) % 10 != 0}
    used = Counter(g[-1] for i in learn for g in grams[i])
    ways = huffman([used[x] for x in range(257)])
    counts = defaultdict(lambda: [0, 0])
    for i, gs in grams.items():
        for g in gs:
            for node, bit in ways[g[-1]]:
                for d in range(depth + 1):
                    counts[g[depth - d : depth], node][bit] += i in learn
    own = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for k, (a, b) in counts.items()}
    weight, kids = {}, defaultdict(float)
    for k in sorted(counts, key=lambda k: -len(k[0])):
        if len(k[0]) == depth:
            weight[k], whole = 1.0, own[k]
        else:
            top = max(own[k], kids[k])
            both = top + math.log(math.exp(own[k] - top) + math.exp(kids[k] - top))
            weight[k], whole = math.exp(own[k] - both), both - math.log(2)
        if k[0]:
            kids[k[0][1:], k[1]] += whole

    def log(g):
        out = 0.0
        for node, bit in ways[g[-1]]:
            one, rest = 0.0, 1.0
            for d in range(depth + 1):
                k = g[depth - d : depth], node
                a, b = counts[k]
                one += rest * weight[k] * (b + 0.5) / (a + b + 1)
                rest *= 1 - weight[k]
            out += math.log10(one if bit else 1 - one)
        return out

    return {i: sum(map(log, gs)) for i, gs in grams.items()}


def test_context_tree_equals_brute_force(docs, texts):
    short = {i: t for i, t in texts.items() if len(t or "") < 2000}
    mine = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 2000)
    depths = {2: brute_ctw(short, 2), ctw.DEPTH: brute_ctw(short, ctw.DEPTH)}
    tokens = {i: [*WORD.findall((t or "").encode().translate(LOW)), None] for i, t in short.items()}
    count = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    for chunk, depth in ((1 << 24, ctw.DEPTH), (700, 2)):
        want = depths[depth]
        got = {r.doc_id: r for r in ctw.scored(mine, depth=depth, chunk=chunk).collect()}
        assert set(got) == set(short)
        for i, r in got.items():
            assert abs(r.score - want[i]) < 1e-6 * max(1, abs(want[i]))
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens[i]), sum(count[w] > 0 for w in tokens[i]), n)
            assert abs(r.base_score - sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[i])) < 1e-6


def test_context_tree_probabilities_sum_to_one(spark, docs, texts):
    """After one context, the probabilities of all 257 symbols add up to one."""
    rows = [(int(c * ctw.SYMBOLS + x), 3 if x in (10, 97) else 0) for c in (5,) for x in range(257)]
    p = ctw.gram_scores(spark.createDataFrame(rows, "gram long, n long"), 1).collect()
    assert abs(sum(10**r.p for r in p) - 1) < 1e-9


def test_held_out_texts_score_above_the_unigram_base(spark):
    """From a thousand documents on; two hundred are too few for it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = ctw.scored(docs).where(fold(F.col("doc_id"), 10) == 0).agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert held.score > held.base


def test_packed_numbers():
    for values in (np.array([], np.int64), np.array([1, -5, 2**62]), np.array([0.5, -1.25], np.float32), np.arange(1000.0)):
        assert (ctw.unpack(ctw.pack(values), values.dtype.type) == values).all()


def test_context_tree_of_nothing(no_docs):
    assert ctw.scored(no_docs).collect() == []


def plain_forward(net, text):
    """Mean distribution over a text's bytes, window by window and byte by byte, in plain double precision."""
    w = {k: v.astype(np.float64) for k, v in net.w.items()}
    h, soft = net.h, lambda x: x / (1 + np.abs(x))
    total, data = np.zeros(len(net.langs)), text.encode()
    for a in range(0, len(data), langid.WINDOW):
        part = data[a : a + langid.WINDOW]
        states = {}
        for d, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
            state = np.zeros(h)
            for i in order:
                x = w[f"x{d}"][:, part[i]]
                gates = 0.5 + 0.5 * soft(x[: 2 * h] + w[f"u{d}"][: 2 * h] @ state)
                cand = soft(x[2 * h :] + w[f"u{d}"][2 * h :] @ (gates[h:] * state))
                state = state + gates[:h] * (cand - state)
                states[d, i] = state
        for i in range(len(part)):
            logit = w["of"] @ states["f", i] + w["ob"] @ states["b", i] + w["c"][:, 0]
            e = np.exp(logit - logit.max())
            total += e / e.sum()
    return total / max(1, len(data))


def test_language_equals_a_plain_forward_pass(docs, texts, no_docs):
    net = langid.Network(["aa", "bb", "cc"], seed=5)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predictions(docs, net).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        if not re.search(r"[^\W\d_]", t or ""):
            assert got[i] == ("und", 0.0)
            continue
        p = plain_forward(net, t[:2000]) if len(t) <= 2000 else None
        if p is not None:
            assert got[i][0] == net.langs[p.argmax()] and abs(got[i][1] - p.max()) < 1e-4
    twice = docs.union(docs)
    assert langid.predictions(twice, net).count() == 2 * len(texts)
    assert langid.predictions(no_docs, net).count() == 0 and langid.keep_known(no_docs).count() == 0


def test_quality_equals_plain_densities(spark, docs, texts, no_docs):
    """The score is the ratio of two normal densities with shrunk covariances, here by inverse and determinant."""
    import pyarrow as pa

    labels = {i: i % 2 for i in texts}
    found = quality.measured(docs)
    model = quality.fit(found, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))
    x = {i: quality.statistics(pa.array([t], pa.string()))[0] for i, t in texts.items()}
    learn = [i for i in texts if zlib.crc32(str(i).encode()) % 4 != 2]
    every = np.array([x[i] for i in learn])
    scale = np.sqrt(np.maximum(every.var(axis=0), 1e-6))
    share = (sum(labels[i] for i in learn) + 1) / (len(learn) + 2)
    logs = {}
    for k in (0, 1):
        mine = np.array([x[i] for i in learn if labels[i] == k])
        cov = np.cov(mine.T, bias=True) / np.outer(scale, scale)
        weight = min(1.0, 0.1 + quality.D / len(mine))
        cov = (1 - weight) * cov + weight * np.diag(np.diag(cov)) + 0.02 * np.eye(quality.D)
        far = (np.array([x[i] for i in texts]) - mine.mean(axis=0)) / scale
        logs[k] = -0.5 * np.einsum("ij,jk,ik->i", far, np.linalg.inv(cov), far) - 0.5 * np.linalg.slogdet(cov)[1]
    gap = np.clip(logs[1] - logs[0] + np.log(share / (1 - share)), -500, 500)
    want = dict(zip(texts, 1 / (1 + np.exp(-gap)), strict=True))
    got = {r.doc_id: r.score for r in quality.scores(found, model).collect()}
    assert set(got) == set(texts) and all(abs(got[i] - want[i]) < 1e-6 for i in texts)
    assert quality.scores(quality.measured(docs.union(docs)), model).count() == 2 * len(texts)
    assert quality.scores(quality.measured(no_docs), model).count() == 0
