import random

import numpy as np

from assertia.llm import toxicity as T
from assertia.llm.common import bucket_of

STEMS = ["grobl", "zwick"]
PLAIN = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in ("n", "st", "rm", "")]


def corpus(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        w = [rng.choice(PLAIN) for _ in range(rng.randrange(5, 90))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(STEMS) + rng.choice(["", "en", "ung", f"x{rng.randrange(50)}"]))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_windows_cover():
    for n in range(0, 200):
        starts = T.window_starts(n)
        assert {i for s in starts for i in range(s, min(n, s + T.SIZE))} == set(range(n))
        assert all(s + T.SIZE <= n or n < T.SIZE for s in starts)


def test_gradients_match_differences():
    words = [b"alpha", b"be", b"c", "délta".encode()]
    net = T.Network(words[:2])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    at = rng.integers(0, 4, (T.SIZE, 3))
    mask = np.arange(T.SIZE)[:, None] < np.array([T.SIZE, 5, 0])
    target, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.0, 0.2])

    def loss():
        logits, _ = net.forward(net.inputs(words)[0] @ net.p["w"] + net.p["b"], at, mask)
        return float((weight * (np.logaddexp(0, logits) - target * logits)).sum())

    grads = net.gradients(words, at, mask, target, weight)
    for name, value in net.p.items():
        flat, grad = value.reshape(-1), grads[name].reshape(-1)
        for i in np.argsort(-np.abs(grad))[:3]:
            kept, e = flat[i], 1e-3
            flat[i] = kept + e
            up = loss()
            flat[i] = kept - e
            down = loss()
            flat[i] = kept
            assert abs((up - down) / (2 * e) - grad[i]) < 2e-2 * max(1e-3, abs(grad[i])), name


def test_held_out_and_edges(spark):
    rows = corpus(900, 1)
    extra = [(1000, None), (1001, ""), (1002, "..."), (1003, rows[0][1] + " x" * 20_000), (None, rows[1][1]), (1, rows[1][1])]
    docs = spark.createDataFrame([r[:2] for r in rows] + extra, "doc_id long, text string").selectExpr("*", "1 as score", "2 as toxic")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1000, 0), (5000, 1), (None, 1), (1001, None)], "doc_id long, toxic int")
    out = T.toxicity(docs, labels, bucket_of(labels.doc_id, 3) != 1).collect()
    assert len(out) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in out)
    score = {r.doc_id: r.score for r in out}
    assert score[1000] == score[1001] == score[1002]
    held = docs.where(bucket_of(docs.doc_id, 3) == 1).select("doc_id").collect()
    truth = {i: y for i, _, y in rows}
    right = [(score[r.doc_id] >= 0.7) == bool(truth[r.doc_id]) for r in held if r.doc_id in truth]
    assert np.mean(right) > 0.95
    empty = T.toxicity(docs.limit(0), labels.limit(0), bucket_of(labels.doc_id, 3) != 1)
    assert empty.count() == 0


def plain_score(net, text):
    """Highest window logit by plain loops: one window, one step and one unit at a time."""
    import math

    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    h_, sig = T.HIDDEN, lambda x: 1 / (1 + math.exp(-x))
    w = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in text).split()

    def vector(word):
        marked = b"<" + word + b">"
        codes = []
        for i in range(len(marked) - 2):
            three = marked[i] << 16 | marked[i + 1] << 8 | marked[i + 2]
            codes.append((three * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - T.CHAR_BITS))
            if i + 3 < len(marked):
                codes.append((((three << 8 | marked[i + 3]) & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - T.CHAR_BITS))
        chars = [sum(p["char"][c][j] for c in codes) / len(codes) for j in range(T.CHAR_DIM)]
        x = p["word"][net.index.get(word, 0)] + chars
        return [sum(x[i] * p["w"][i][j] for i in range(len(x))) + p["b"][j] for j in range(6 * h_)]

    def direction(xs, u):
        h, out = [0.0] * h_, []
        for x in xs:
            g = [sum(h[i] * u[i][j] for i in range(h_)) for j in range(3 * h_)]
            z = [sig(x[j] + g[j]) for j in range(h_)]
            r = [sig(x[h_ + j] + g[h_ + j]) for j in range(h_)]
            new = [math.tanh(x[2 * h_ + j] + r[j] * g[2 * h_ + j]) for j in range(h_)]
            h = [new[j] + z[j] * (h[j] - new[j]) for j in range(h_)]
            out.append(h)
        return out

    if not w:
        return p["c"][0]
    xs, best = [vector(x) for x in w], -math.inf
    starts = {0, *(s for s in range(0, len(w), T.STRIDE) if s + T.SIZE <= len(w)), max(0, len(w) - T.SIZE)}
    for s in starts:
        part = xs[s : s + T.SIZE]
        ahead = direction([x[: 3 * h_] for x in part], p["uf"])
        back = direction([x[3 * h_ :] for x in part][::-1], p["ub"])[::-1]
        states = [a + b for a, b in zip(ahead, back)]
        e = [sum(math.tanh(sum(state[i] * p["a"][i][j] for i in range(2 * h_))) * p["v"][j] for j in range(T.ATTENTION)) for state in states]
        top = max(e)
        alpha = [math.exp(x - top) for x in e]
        pooled = [sum(a * state[i] for a, state in zip(alpha, states)) / sum(alpha) for i in range(2 * h_)]
        best = max(best, sum(pooled[i] * p["o"][i] for i in range(2 * h_)) + p["c"][0])
    return best


def test_scores_against_plain_loops():
    rows = [(t.encode(), y) for _, t, y in corpus(150, 4)]
    net = T.train(rows, steps=(20, 20))
    tried = [rows[0][0], b"", b"...", b"one", "Grobl ÉTÉ zwickung 77".encode(), rows[1][0] * 3, b" ".join([b"ban"] * 32), b" ".join([b"ban"] * 33), b"x y" * 70]
    got, _ = net.scores(tried)
    for text, score in zip(tried, got.tolist(), strict=True):
        assert abs(score - plain_score(net, text)) < 1e-3 * max(1, abs(score))
