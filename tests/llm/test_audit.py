import re
from itertools import permutations

from pyspark.sql import functions as F

from tidecast.llm import audit as A

MEASURES = A.MEASURES


def brute(rows, filters):
    """``{(order, step): measures}`` by playing each order; rows are failing letters, good, toxic."""
    steps, shapley = {}, dict.fromkeys(filters, 0)
    for order in permutations(filters):
        left = list(rows)
        for k, f in enumerate(order, 1):
            gone = [r for r in left if f in r[0]]
            left = [r for r in left if f not in r[0]]
            failing = sum(f in r[0] for r in rows)
            shapley[f] += len(gone)
            steps["".join(order), k] = [len(left), len(gone), failing - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
    return {(o, k): (*v, shapley[o[k - 1]]) for (o, k), v in steps.items()}


def test_swaps_lead_through_all_orders():
    for n in range(1, 7):
        order, seen = list(range(n)), [tuple(range(n))]
        for i in A.swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(permutations(range(n)))


def test_exchange_keeps_equal_nodes_one():
    masks = {m: (m % 3, 0, 0) for m in range(32)}
    diagram = A.Diagram(masks, 5, 3)
    for i in A.swaps(5):
        diagram.swap(i)
        assert all(len(set(nodes)) == len(nodes) for nodes in diagram.levels)
        assert diagram.weights[0] == [(sum(m % 3 for m in range(32)), 0, 0)]
    fresh = A.Diagram({sum(1 << p for p, f in enumerate(diagram.order) if m >> f & 1): w for m, w in masks.items()}, 5, 3)
    assert [len(n) for n in fresh.levels] == [len(n) for n in diagram.levels]


def test_audit_equals_played_orders(spark):
    import random

    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), {f for f in "VWXY" if r.random() < 0.3}, r.random() < 0.3, r.random() < 0.2) for _ in range(300)]
    df = spark.createDataFrame([(p, [f in fails or (None if i % 7 == 0 else False) for f in "VWXY"], g, t) for i, (p, fails, g, t) in enumerate(rows)], "source string, f array<boolean>, good boolean, toxic boolean")
    got = A.filter_interactions(df.repartition(3), {f: F.col("f")[i] for i, f in enumerate("VWXY")}, part="source", good=F.col("good"), toxic=F.col("toxic")).collect()
    for part in ("a", "b", None):
        want = brute([(fails, g, t) for p, fails, g, t in rows if p == part], "VWXY")
        found = {(x.filter_order, x.step): tuple(x[m] for m in MEASURES) for x in got if x.part == (part or "")}
        assert found == want
    assert A.filter_interactions(df.where("false"), {"V": F.lit(True)}, part="source").collect() == []


def test_failures_by_definition(docs):
    many = [f"w{i}" for i in range(300)]
    texts = [" ".join(many), " ".join(many), " ".join(many[:100] * 3), "A" + " ".join(many), "A" * 30 + " ".join(many), " ".join(many) + " #", None, "", "Z", "\x0b".join(many), "\x85".join(many), "long Word " * 60_000, " ".join(many)]
    got = {r.doc_id: r for r in A.failures(docs(texts, extra=True).repartition(3)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        want = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), (t in [x or "" for x in texts[:i]]))
        assert tuple(got[i][f] for f in "ABCDE") == want, i


def test_hot_copies_repeated_and_null_ids(spark):
    rows = [(i, "hot", 1) for i in range(50)] + [(7, "two", 1), (7, "two", 1), (9, "two", 1), (None, "two", 1), (None, "one", 1), (100, "one", 1)]
    df = spark.createDataFrame(rows, "doc_id long, k string, l int")
    for hot in (1000, 2):
        A.HOT, before = hot, A.HOT
        got = sorted(((r.doc_id, r.k, r.repeats) for r in A.repeats(df, "doc_id", ["k", "l"]).collect()), key=str)
        A.HOT = before
        assert got == sorted([(i, "hot", i > 0) for i in range(50)] + [(7, "two", False)] * 2 + [(9, "two", True), (None, "two", False), (None, "one", False), (100, "one", False)], key=str)
