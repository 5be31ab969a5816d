"""Features, scores and training against plain versions that go word by word and row by row."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from cadenza.llm import quality

S = quality.Settings(buckets=509, dim=3, epochs=2)


def plain_features(text, s):
    words = text.split()
    out = []
    for w in words:
        out.append(zlib.crc32(f"<{w}>".encode()) % s.buckets)
        for n in range(s.shortest, s.longest + 1):
            out += [zlib.crc32(f"<{w}>"[i : i + n].encode()) % s.buckets for i in range(len(w) + 3 - n)]
    for a, b in zip(words, words[1:]):
        x = (zlib.crc32(a.encode()) ^ zlib.crc32(b.encode())) * 0x9E3779B97F4A7C15 % 2**64
        out.append((x >> 40) % s.buckets)
    return out


def texts():
    rng = random.Random(6)
    vocab = [rng.choice("abcé") * rng.randrange(1, 4) + rng.choice("xyz") for _ in range(25)]
    return ["", "one", "same same same", "é ☃ é"] + [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 60))) for _ in range(30)]


def test_features():
    for t in texts():
        ids, n = quality.document_features(t, S)
        assert dict(zip(ids.tolist(), n.tolist(), strict=True)) == Counter(plain_features(t, S))


def test_scores():
    rng = np.random.default_rng(2)
    m = quality.Model(S, rng.standard_normal(S.buckets), 0.3)
    scorer = quality.Scorer(m)
    for t in texts() * 2:
        f = plain_features(t, S)
        z = m.bias + (sum(m.value[i] for i in f) / len(f) if f else 0)
        assert abs(scorer(t) - 1 / (1 + math.exp(-z))) < 1e-9


def test_training():
    rows = [(t, i % 2) for i, t in enumerate(texts())]
    got = quality.train([quality.document_features(t, S) for t, _ in rows], np.asarray([y for _, y in rows]), S)
    rng = np.random.default_rng(S.seed)
    e = ((rng.random((S.buckets, S.dim), np.float32) - 0.5) / S.dim).astype(float).tolist()
    w, bias = [[-0.1] * S.dim, [0.1] * S.dim], [0.0, 0.0]
    step, steps = 0, S.epochs * len(rows)
    for _ in range(S.epochs):
        for i in rng.permutation(len(rows)):
            f = plain_features(rows[i][0], S)
            rate = S.rate * (1 - step / steps)
            step += 1
            h = [sum(e[x][d] for x in f) / max(1, len(f)) for d in range(S.dim)]
            z = [sum(a * b for a, b in zip(w[k], h)) + bias[k] for k in (0, 1)]
            p = [math.exp(v) / sum(map(math.exp, z)) for v in z]
            p[rows[i][1]] -= 1
            back = [sum(p[k] * w[k][d] for k in (0, 1)) for d in range(S.dim)]
            for k in (0, 1):
                w[k] = [a - rate * p[k] * b for a, b in zip(w[k], h)]
                bias[k] -= rate * p[k]
            for x, n in Counter(f).items():
                e[x] = [a - rate * 20 * n / len(f) * b for a, b in zip(e[x], back)]
    due = [sum(a * (c - b) for a, b, c in zip(v, w[0], w[1])) for v in e]
    assert np.allclose(got.value, due, atol=1e-4) and abs(got.bias - (bias[1] - bias[0])) < 1e-4
