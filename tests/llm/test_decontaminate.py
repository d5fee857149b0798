import pytest

from tidecast.llm.decontaminate import WINDOW, contaminated, decontamination_stage, op5_decontamination
from tidecast.llm.common import text_key

ITEM = "A train leaves Boston at 60 km per hour and travels for 3 hours. How far does the train from Boston go when it keeps its pace all day long?"
CHANGED = "A train leaves Paris at 85 miles per hour and travels for 7 hours. How far does the train from Paris go when it keeps its pace all day long?"
MIXED = CHANGED.replace("from Paris", "from Rome")


def found(docs, items, texts):
    df = docs(texts)
    keyed = df.select("doc_id", *text_key("text"))
    return {(r.doc_id, r.item): r for r in keyed.join(contaminated(df, items), ["k1", "k2"]).collect()}


def test_exact_changed_and_inconsistent(spark, docs):
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "too short"), (None, ITEM)], "item_id long, text string")
    texts = [f"Some words before. {ITEM} And after", f"before {CHANGED} after", f"before {MIXED} after", "nothing alike here at all", "", None, ITEM, ITEM]
    got = found(docs, items, texts)
    assert set(got) == {(d, i) for d in (0, 1, 6, 7) for i in (1, None)}
    assert got[1, 1].slots > 0 and got[6, 1].found == got[6, 1].windows


TOM = "Tom has 3 apples. Tom buys 4 more at the shop. Tom eats 2 of them. How many apples does Tom have now?"
CITY = "How many miles is the way from Boston to Albany if the road from Boston goes over the hills and by the lake to Albany in the north?"
SUM = "Compute 12 + 7 + 9 + 30 + 5 + 8 + 11."
PASSAGE = " ".join(f"word{i}" for i in range(100))


@pytest.mark.parametrize(
    "item, text, held",
    [
        (TOM, TOM.replace("Tom", "Ann").replace("3", "5"), True),
        (CITY, CITY.replace("Boston", "New York").replace("Albany", "Los Angeles"), True),
        (CITY, CITY.replace("from Boston", "from Rome", 1).replace("from Boston", "from Paris"), False),
        (CITY, CITY.lower(), True),
        (CITY, CITY.upper(), True),
        (SUM, SUM, True),
        (SUM, SUM.replace("12", "13").replace("9", "10"), False),
        ("What is the capital of France?", "Q: What is the capital of France?", True),
        ("What is the capital of France?", "the capital of France is what we ask", False),
        ("Name the largest planet.", "we were asked to name the largest planet in class", True),
        ("two words", "here are two words", False),
        ("two words", "Two words!", True),
        (PASSAGE, " ".join(PASSAGE.split()[20:80]), True),
        (PASSAGE, " ".join(PASSAGE.split()[20:50]), False),
        ("The Old Man And The Sea Of Ice", "we read the old man and the sea of ice", True),
    ],
)
def test_forms_of_an_item(spark, docs, item, text, held):
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [text, f"Some words stand before it here. {text} And some more come after it.", "nothing of the kind here at all, not a bit of it"]
    want = {(0, 1), (1, 1)} if item != "two words" else {(0, 1)}
    assert set(found(docs, items, texts)) == (want if held else set())


def test_very_long_text(spark, docs):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert set(found(docs, items, ["and so on it goes for long " * 50_000 + CHANGED, "and so on it goes for long " * 50_000])) == {(0, 1)}


def test_two_changed_copies_in_one_text(spark, docs):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert set(found(docs, items, [CHANGED + " " + ITEM, CHANGED[:60]])) == {(0, 1)}


def test_stage_and_empty_tables(spark, docs, tmp_path):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = decontamination_stage(spark, docs([CHANGED, "clean", None, MIXED], extra=True), str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3] and "k1" in out.columns
    assert contaminated(docs([ITEM]).where("false"), items).collect() == []
    assert contaminated(docs([ITEM]), items.where("false")).collect() == []


def test_whole_tables_against_brute_force(spark):
    """Every document that holds all five-word windows of an item is found, and no one that holds few."""
    import re

    sf = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.item_id) for r in op5_decontamination(spark, sf).collect()}
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    windows = lambda w: {tuple(w[i : i + WINDOW]) for i in range(len(w) - WINDOW + 1)}
    docs = {r.doc_id: windows(words(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: windows(words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    part = {(d, i): len(b & a) / len(b) for d, a in docs.items() for i, b in items.items() if b}
    assert {k for k, v in part.items() if v == 1} <= got <= {k for k, v in part.items() if v >= 0.5}
