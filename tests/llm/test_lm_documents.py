"""Document scores against a plain model: expected counts over all segmentations, then the sum over the text's words."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from lathe.llm import lm_score


def forward_backward(word: bytes, p: dict[bytes, float]) -> tuple[float, Counter]:
    raw = lm_score.START + word
    n = len(raw)
    arcs = [(i, j, raw[i:j]) for j in range(1, n + 1) for i in range(j) if raw[i:j] in p]
    alpha, beta = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for i, j, x in sorted(arcs, key=lambda a: a[1]):
        alpha[j] += alpha[i] * p[x]
    for i, j, x in sorted(arcs, key=lambda a: -a[0]):
        beta[i] += p[x] * beta[j]
    share = Counter()
    for i, j, x in arcs:
        share[x] += alpha[i] * p[x] * beta[j] / alpha[n]
    return math.log(alpha[n]), share


def test_document_scores(spark):
    rng = random.Random(5)
    known = ["the", "house", "Haus", "größe", "niño", "zz9", "a-b", "internationalisation", "x" * 30, "😀"]
    docs = [(i, " ".join(rng.choices(known, k=rng.randrange(0, 12)) + (["".join(rng.choices("abcé", k=6))] if i % 3 else []))) for i in range(30)] + [(30, None), (31, "")]
    got = {r["doc_id"]: r["score"] for r in lm_score.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    tokens = {i: [w.encode() for w in (t or "").lower().split()] for i, t in docs}  # no sign here changes its length in lower case
    pieces, prior = lm_score.vocabulary()
    table = dict(zip(pieces, prior.tolist(), strict=True))
    train, ends = Counter(w for i, ws in tokens.items() if not held[i] for w in ws), sum(not h for h in held.values())
    counts = Counter({x: q * lm_score.PRIOR_TOKENS for x, q in table.items()})
    for word, c in train.items():
        for x, share in forward_backward(word, table)[1].items():
            counts[x] += c * share
    whole = math.fsum(counts.values()) + ends + 1
    model = {x: c / whole for x, c in counts.items()}
    for i, ws in tokens.items():
        want = math.log((ends + 1) / whole) + sum(forward_backward(w, model)[0] for w in ws)
        assert got[i] == pytest.approx(want / math.log(10), rel=1e-9), i


def test_long_words_equal_short_ones(monkeypatch):
    pieces, prior = lm_score.vocabulary()
    lattice = lm_score.Lattice(pieces, lm_score.np.log(prior))
    rng = random.Random(2)
    words = pa.array(["".join(rng.choices("etaoinshrdlu éß中", k=n)).encode() for n in (1, 2, 5, 30, 60, 200, 700)], pa.binary())
    weight = lm_score.np.array([1.0, 2, 3, 1, 5, 2, 7])
    score, counts = lattice.score(words, weight)
    monkeypatch.setattr(lm_score, "LONG_WORD", 0)
    monkeypatch.setattr(lm_score, "BLOCK", 50)
    alone, alone_counts = lattice.score(words, weight)
    assert score == pytest.approx(alone, rel=1e-12) and counts == pytest.approx(alone_counts, rel=1e-9, abs=1e-9)


def test_an_unbroken_text_of_megabytes():
    pieces, prior = lm_score.vocabulary()
    lattice = lm_score.Lattice(pieces, lm_score.np.log(prior))
    text = "".join(random.Random(1).choices("etaoinshrdlu", k=400_000)).encode()
    assert -10 < float(lattice.score(pa.array([text], pa.binary()))[0][0]) / len(text) < 0
