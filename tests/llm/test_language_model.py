"""The language model against plain loops: counts, the network's steps, its gradient, and what it learns."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidelane.llm import language_model as L
from tidelane.llm import recurrent as R


def network(frequent=32, other=4, seed=1):
    net, random = R.Network.fresh(np.arange(frequent + other, 0, -1), other), np.random.default_rng(seed)
    net.flat += random.normal(0, 0.2, len(net.flat)).astype(R.F32)
    return net


def step_by_step(net, symbols):
    """Log probability of one document, in double precision, a symbol at a time."""
    p, h = {k: x.astype(float) for k, x in net.part.items()}, np.zeros(R.HIDDEN)
    sigma, total, n = lambda x: 1 / (1 + np.exp(-x)), 0.0, R.HIDDEN
    for s in symbols:
        seen = np.append(h, 1.0)
        kind = s // R.WORDS if s < net.frequent else s - net.frequent + net.near
        e = np.exp(seen @ p["c"])
        total += math.log(e[kind] / e.sum())
        if s < net.frequent:
            e = np.exp(seen @ p["w"][kind])
            total += math.log(e[s % R.WORDS] / e.sum())
        x, a = p["x"][s], h @ p["u"]
        z, r = sigma(x[:n] + a[:n]), sigma(x[n : 2 * n] + a[n : 2 * n])
        new = np.tanh(x[2 * n :] + r * a[2 * n :])
        h = z * h + (1 - z) * new
    return total


def test_documents_are_scored_whole_in_lanes():
    random = np.random.default_rng(3)
    documents = [random.integers(0, 36, n).astype(np.int16) for n in (1, 700, 40, 3, 17, 16, 33, 250, 1, 5) * 4]
    net = network()
    got = R.score(net, documents)
    assert np.allclose(got, [step_by_step(net, d) for d in documents], rtol=1e-4, atol=1e-3)
    assert R.score(net, []).shape == (0,)


def test_all_next_symbols_add_up_to_one():
    net, before = network(), [3, 35, 12, 31]
    base = step_by_step(net, before)
    each = R.score(net, [np.array([*before, s], np.int16) for s in range(36)])
    assert abs(np.exp(each - base).sum() - 1) < 1e-3


def test_gradient():
    net, random = network(), np.random.default_rng(5)
    symbols, starts = random.integers(-1, 36, (6, 5)).astype(np.int32), random.random((6, 5)) < 0.2
    state, grad = random.normal(0, 0.5, (5, R.HIDDEN)).astype(R.F32), R.Network(32, 4)
    net.window(symbols, starts, state, grad, 0.1)
    for k in random.choice(len(net.flat), 80):
        old, sides = net.flat[k], []
        for by in (0.01, -0.01):
            net.flat[k] = old + by
            sides.append(-0.1 * net.window(symbols, starts, state)[0].sum(dtype=float))
        net.flat[k] = old
        assert abs((sides[0] - sides[1]) / 0.02 - grad.flat[k]) < 2e-3


def test_training_learns_an_order():
    cycle = [np.tile(np.arange(32, dtype=np.int16), 30) for _ in range(64)]
    net, squares = R.Network.fresh(np.ones(36), 4), None
    squares = np.full(len(net.flat), 1e-4, R.F32)
    before = R.score(net, cycle[:1])[0]
    for _ in range(4):
        assert R.train(net, squares, cycle) == 64 * 960
    assert R.score(net, cycle[:1])[0] > 0.5 * before


ROWS = [(k, " ".join(f"w{(k * j) % 7} the" for j in range(30)) + f" Rare{k}") for k in range(60)]
ODD = [(61, None), (62, ""), (63, " \n\t "), (64, "THE the"), (64, "THE the"), (None, "the \xa0 x\x1cy"), (65, "long" * 30), (66, "never seen words é"), (67, "w1 " * 5000)]


def by_hand(rows):
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    cut = [(i, held(i), (t or "").encode().lower().split() + [b""]) for i, t in rows]
    c = Counter(w for _, h, ws in cut if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, h, ws in cut]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("x"), "n": F.lit(0), "symbols": F.lit(1), "word": F.lit("w")})


def test_counts_and_bases_with_few_known_words(spark):
    rows = ROWS + ODD
    want = sorted(by_hand(rows), key=repr)
    for known in (L.KNOWN, 20, 0):
        got = L.language_model(table(spark, rows), L.in_seventh(F.col("doc_id")), known).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_shares_of_other_words_add_up(spark):
    """Within each class the words that were counted and one never seen have all the chance."""
    counts = L.word_counts(table(spark, ROWS).select("text"))
    v = L.Vocabulary.of(counts)
    index, total = L._index(v.known), np.zeros(L.OTHER)
    for w, n in ((bytes(r.word), r.n) for r in counts.collect()):
        if index[w] >= v.frequent:
            k = v.endings.index(w[-2:]) if w[-2:] in v.endings else L.OTHER - 1
            total[k] += (n + 1) / 10 ** v.class_log[k]
    assert np.allclose(total + 1 / 10**v.class_log, 1)


def test_model_beats_unigrams_on_held_out_texts(spark, sf_dir):
    got = L.language_model(spark.read.parquet(f"{sf_dir}/documents.parquet"), L.in_seventh(F.col("doc_id"))).filter("held_out")
    base, model = got.agg(F.sum("base_score"), F.sum("score")).first()
    assert model > base


def test_nothing_to_learn_from(spark):
    docs = table(spark, ROWS[:3])
    got = L.language_model(docs, F.lit(True)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in got] == [(0, 0, 0.0)] * 3
    assert all(math.isfinite(r.score) for r in got)
    assert L.language_model(docs.limit(0), F.lit(False)).count() == 0
