"""Near copies of the pipeline's stage against all pairs."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from lathe.llm import near


def plain_set(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def some_texts(groups=30, each=6):
    rng, out = random.Random(8), []
    for _ in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        for _ in range(each):
            own = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 30)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(5000)}"
            out.append(" ".join(own))
    rng.shuffle(out)
    return [*out, "", "a b", "A b"]


@pytest.mark.parametrize("small", [32, 1])
def test_near_copies_are_joined_as_by_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(near, "SMALL", small)
    texts = some_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    got = dict(near.merged(rows, rows.select("row", rows["row"].alias("c"))).collect())
    want = plain_groups(texts)
    assert len(set(zip([got[i] for i in range(len(texts))], want, strict=True))) == len(set(got.values())) == len(set(want))
    assert len(set(want)) < len(texts)


def test_stage_keeps_no_near_copies(spark, sf_dir):
    words = [f"w{i}" for i in range(300)]
    other = [*words]
    for i in (40, 90, 140, 190, 240, 290):
        other[i] = f"other{i}"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:150]))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()) == [1, 3]


def test_rows_without_a_partner_of_like_size_rest(spark, monkeypatch):
    """A large group and a text that shares keys with it, too short to be a near copy: nothing is left to compare."""
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join([*words[:k], "odd", *words[k + 1 :]]) for k in range(0, 200, 5)] + [" ".join(words[:300]), " ".join(words[200:])]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    left, cut = [], near.cut

    def counted(df, name, **more):
        out = cut(df, name, **more)
        if name == "near-live":
            left.append(out.count())
        return out

    monkeypatch.setattr(near, "cut", counted)
    got = dict(near.merged(rows, rows.select("row", rows["row"].alias("c"))).collect())
    assert len({got[i] for i in range(40)}) == 1 and len(set(got.values())) == 3
    assert left == [0]


@pytest.mark.parametrize("large", [False, True])
def test_pairs_that_are_no_near_copies_become_no_rows(spark, monkeypatch, large):
    """Texts of one template, of which each pair has some 0.7 in common and few more: their pairs grow with the square of their number."""
    if large:
        monkeypatch.setattr(near, "SMALL", 1)
        monkeypatch.setattr(near, "HUBS", 8)
        monkeypatch.setattr(near, "ROWS_PER_SALT", 16)
    words, rng = [f"w{i}" for i in range(300)], random.Random(4)
    texts = [" ".join([*words[:130], *(f"x{k}-{i}" for i in range(40)), *words[170:]]) for k in range(50)]
    texts += [t.replace("w20 ", "other ").replace("w250 ", f"o{k} ") for k, t in enumerate(texts[:10])]
    rng.shuffle(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(2)
    made, cut = [], near.cut

    def counted(df, name, **more):
        out = cut(df, name, **more)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(near, "cut", counted)
    got = dict(near.merged(rows, rows.select("row", rows["row"].alias("c"))).collect())
    want = plain_groups(texts)
    assert len(set(zip([got[i] for i in range(60)], want, strict=True))) == len(set(got.values())) == len(set(want)) == 50
    assert max(n for name, n in made if name not in ("near-buckets", "near-live")) <= 60
    assert large or sum(name == "near-live" for name, _ in made) <= 2
