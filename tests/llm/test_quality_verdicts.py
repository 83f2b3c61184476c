"""Every coverage and the verdict against a plain version, short n-grams by stretch."""

from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from lathe.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(words, n):
    grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    inside = {j for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}
    return sum(len(words[j]) for j in inside)


def plain(text, stretch):
    words = WORD.findall(text)
    total = max(1, sum(map(len, words)))
    out = {}
    for n in quality.NGRAM_BOUNDS:
        parts = [words[i : i + stretch] for i in range(0, len(words), stretch)] if n <= quality.SHORT else [words]
        out[n] = sum(covered(p, n) for p in parts) / total
    seen, held = set(), 0
    for line in text.split("\n"):
        own = WORD.findall(line)
        if own:
            held += sum(map(len, own)) if line in seen else 0
            seen.add(line)
    failed = len(words) < quality.MIN_WORDS or 100 * covered_words(words) > 30 * len(words)
    return out, held / total, not failed and held / total <= quality.LINE_BOUND and all(out[n] <= b for n, b in quality.NGRAM_BOUNDS.items())


def covered_words(words):
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)})


@pytest.mark.parametrize("stretch", [7, 40, 4000])
def test_measures_and_verdicts(monkeypatch, stretch):
    monkeypatch.setattr(quality, "STRETCH", stretch)
    rng = random.Random(stretch)
    texts = ["", " \n ", "a b"] + ["".join(rng.choice(["ab", "c", "déf", "gh", "i"] if n % 2 else [f"w{rng.randrange(400)}"]) + rng.choice("  \n\t") for _ in range(rng.randrange(1, 150))) for n in range(60)]
    texts += [f"{x}\n{x}\nmore of it {n}" for n, x in enumerate(texts[5:15])]
    m = quality.measure(pa.array(texts))
    _, kept = quality.judge(m)
    for i, text in enumerate(texts):
        cover, lines, verdict = plain(text, stretch)
        assert [m[f"coverage_{n}"][i] for n in cover] == pytest.approx(list(cover.values())) and m["line_coverage"][i] == pytest.approx(lines) and bool(kept[i]) == verdict, i


def test_long_clean_prose_stays():
    rng = random.Random(1)
    words = [f"w{n}" for n in range(3000)]
    weights = [1 / (n + 3) for n in range(3000)]
    for size in (2000, 60_000):
        assert quality.judge(quality.measure(pa.array([" ".join(rng.choices(words, weights, k=size))])))[1][0]
