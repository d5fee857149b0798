import random

import numpy as np
import pytest

from tidecast.llm import minhash as M
from tidecast.llm.graphs import components


def vocabulary(seed, n):
    r = random.Random(seed)
    return [f"{r.choice('abcdefgh')}{r.randrange(10**6)}" for _ in range(n)]


def edited(words, seed, times):
    r, out = random.Random(seed), list(words)
    for _ in range(times):
        out[r.randrange(len(out))] = f"new{r.randrange(10**6)}"
    return out


def jaccard(a, b):
    """The definition, element by element."""
    p, q = (dict(zip(*map(np.ndarray.tolist, x), strict=True)) for x in (a, b))
    if not p or not q:
        return float(not p and not q)
    both = set(p) | set(q)
    return sum(1 / sum(max(p.get(z, 0) / p[x], q.get(z, 0) / q[x]) for z in both) for x in set(p) & set(q))


def classes(texts, similarity=0.8):
    sets = [M.weighted_shingles([t])[:2] for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or (len(sets[i][0]) and M.probability_jaccard(sets[i], sets[j]) >= similarity):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def sample():
    base = vocabulary(1, 200)
    texts = [" ".join(base)] * 3 + [" ".join(edited(base, s, 3)) for s in range(40)]
    texts += [" ".join(edited(base, 100 + s, 9)) for s in range(15)]  # around the limit
    shared = vocabulary(2, 14)
    texts += [" ".join(shared + vocabulary(300 + s, 12)) for s in range(40)]  # alike, but not enough
    chain = vocabulary(3, 120)
    for s in range(6):
        texts.append(" ".join(chain))
        chain = chain[:20 * s] + [f"c{s}", *chain[20 * s + 1 :]]
    return texts + ["", None, "  ", "one two", "One  two", "a b c d", "a b c d e"]


def test_exact_similarity_by_definition():
    texts = [t for t in sample()[:60:6]] + ["a a a a a a b c d e f a a a a a", "a a a a a a b c d e f", ""]
    sets = [M.weighted_shingles([t])[:2] for t in texts]
    for a in sets:
        for b in sets:
            assert M.probability_jaccard(a, b) == pytest.approx(jaccard(a, b))


def test_signatures_estimate_the_similarity():
    base = vocabulary(5, 300)
    texts = [" ".join(base), " ".join(edited(base, 1, 10)), " ".join(base + base[:150])]
    element, weight, doc = M.weighted_shingles(texts)
    winners = M.signatures(element, weight, doc, 3, 4000)
    sets = [M.weighted_shingles([t])[:2] for t in texts]
    for i, j in ((0, 1), (0, 2), (1, 2)):
        assert (winners[i] == winners[j]).mean() == pytest.approx(jaccard(sets[i], sets[j]), abs=0.04)


@pytest.mark.parametrize("bound", [512, 8])
def test_classes_by_brute_force(docs, monkeypatch, bound):
    """Also with a bound that sends buckets through the way for large ones."""
    monkeypatch.setattr(M, "BUCKET_ROWS", bound)
    texts = sample()
    got = {r.doc_id: r for r in M.near_duplicates(docs(texts, extra=True)).collect()}
    assert [got[i].class_id for i in range(len(texts))] == classes(texts)
    firsts = [r.doc_id for r in got.values() if r.first]
    assert sorted(firsts) == sorted(set(classes(texts)))


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "x y z")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.class_id or -1, r.first) for r in M.near_duplicates(df).collect())
    assert [g[:2] for g in got] == [(-1, -1), (-1, 5), (5, 5), (5, 5)] and sum(g[2] for g in got) == 2
    assert M.near_duplicates(df.where("false")).collect() == []


def test_stage_keeps_one_of_each(spark, docs):
    texts = sample()
    out = M.dedup_stage(spark, docs(texts), "")
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(classes(texts))) and out.columns == docs(texts).columns


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 50), (100, 60), (7, 7)], "a long, b long")
    got = dict(map(tuple, components(links).collect()))
    assert got == {**dict.fromkeys(range(21), 0), 50: 50, 60: 50, 100: 50}


def test_many_against_one_by_definition():
    """The way that holds a text against many at once, with and without repeated shingles."""
    r = random.Random(9)
    base = vocabulary(11, 60)
    texts = [" ".join(edited(base, s, r.randint(0, 3))) for s in range(25)]
    texts += [" ".join(edited(base + base[: r.randint(5, 50)], 50 + s, r.randint(0, 3))) for s in range(25)]
    texts += [" ".join(base[: 30 + s] * r.randint(1, 3)) for s in range(10)]
    sets = [M.weighted_shingles([t])[:2] for t in texts]
    made = list(M.shingles_of(texts))
    part = M.Part([np.frombuffer(h, np.uint64) for h, _ in made], [None if w is None else np.frombuffer(w, float) for _, w in made])
    assert any(w is None for _, w in made) and any(w is not None for _, w in made)
    for i in range(len(texts)):
        others = np.array([j for j in range(len(texts)) if j != i])
        want = [jaccard(sets[i], sets[j]) >= 0.8 for j in others]
        assert part.similar(i, others, 0.8).tolist() == want


def test_recall_and_bounded_work(docs, monkeypatch):
    """A group of copies with a few changed words each: nearly all similar pairs end in one class, no pair is worked out twice."""
    base = vocabulary(21, 150)
    texts = [" ".join(edited(base, s, 1 + s % 4)) for s in range(120)] + [" ".join(vocabulary(1000 + s, 150)) for s in range(80)]
    sets = [M.weighted_shingles([t])[:2] for t in texts]
    alike = [(i, j) for i in range(120) for j in range(i) if M.probability_jaccard(sets[i], sets[j]) >= 0.8]
    found = {r.doc_id: r.class_id for r in M.near_duplicates(docs(texts)).collect()}
    assert len(alike) > 100 and sum(found[i] == found[j] for i, j in alike) >= 0.99 * len(alike)
    assert all(found[i] == i for i in range(120, 200))
    assert [found[i] for i in range(len(texts))] == classes(texts)


def test_first_shared_band_decides():
    texts = ["a b c d e f g h", "a b c d e f g h", "a b c d e f g i"]
    made = list(M.shingles_of(texts))
    part = M.Part([np.frombuffer(h, np.uint64) for h, _ in made], [None] * 3)
    sigs, keys = np.zeros((3, 4), np.uint8), np.array([[1, 9], [1, 9], [2, 9]])
    asked = []
    monkey = lambda i, others, s: asked.append((i, others.tolist())) or np.zeros(len(others), bool)
    part.similar = monkey
    list(M.group_links([0, 1, 2], [0, 1, 2], [True] * 3, sigs, keys, 1, part, 0.8))
    assert asked == [(0, [2]), (1, [2])]
