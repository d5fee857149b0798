import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tidecast.llm.quality import measure, quality_rules, quality_stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, copies = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), copies, len(marked)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t\x0b\x1c\x85é#|"), max_size=60))
def test_measures_by_definition(text):
    m = measure(text, "h")
    assert tuple(m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(text)


def body(i, n=80):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_template_lines_go_and_depleted_documents_with_them(spark, docs):
    frame = " ".join(f"frame{k}" for k in range(40))
    texts = [f"{frame}\n{body(i)}" for i in range(25)]  # a template on 25 different documents
    texts += [f"{frame}\n{body(200 + i, 12)}" for i in range(2)]  # little else
    texts += [body(500) + "\n" + body(501)] * 30  # one text, copied: no template
    texts += [None, "", "too short"]
    df = docs(texts, extra=True)
    got = {r.row.doc_id: r for r in quality_rules(df).collect()}
    assert all(got[i].kept and got[i].n_removed == 40 for i in range(25))
    assert all(not got[i].kept and not got[i].base_failed for i in (25, 26))
    assert all(got[i].kept and got[i].n_removed == 0 for i in range(27, 57))
    assert all(got[i].base_failed and not got[i].kept for i in (57, 58, 59))
    out = {r.doc_id: r for r in quality_stage(spark, df, "").collect()}
    assert sorted(out) == sorted(i for i, r in got.items() if r.kept)
    assert out[0].text == body(0) and out[0].n_chars == len(body(0)) and out[0].spans == "own spans"


def test_mostly_template_pages_and_a_copied_carrier(docs):
    """A template decides by itself neither which pages are different nor, if one page is copied much, that they are few."""
    for host, part in enumerate((160, 180)):  # 80 and 90 % of 200 words, in lines of 20
        for template in range(8):
            frame = "\n".join(" ".join(f"frame{host}x{template}x{k}x{j}" for j in range(20)) for k in range(part // 20))
            texts = [f"{frame}\n{body(1000 * template + i, 200 - part)}" for i in range(25)]
            df = docs(texts, source=f"{host} {template}")
            everything = df if not (host or template) else everything.unionByName(df)
    got = quality_rules(everything).collect()
    assert len(got) == 400 and all(not r.base_failed and not r.kept and r.n_removed in (160, 180) for r in got)
    frame = " ".join(f"frame{k}" for k in range(40))
    copied = quality_rules(docs([f"{frame}\n{body(i)}" for i in range(20)] + [f"{frame}\n{body(99)}"] * 60)).collect()
    assert all(r.kept and r.n_removed == 40 for r in copied)
    few = quality_rules(docs([f"{frame}\n{body(i)}" for i in range(18)] + [f"{frame}\n{body(99)}"] * 60)).collect()
    assert all(r.kept and r.n_removed == 0 for r in few)


def copies(i, words=120, line=10, edits=1):
    """A text in lines with a few words changed."""
    r = random.Random(i)
    out = [f"base{k}" for k in range(words)]
    for _ in range(edits):
        out[r.randrange(words)] = f"new{i}x{r.randrange(1000)}"
    return "\n".join(" ".join(out[k : k + line]) for k in range(0, words, line))


def test_near_copies_make_no_template(docs):
    for edits in (1, 3):
        got = quality_rules(docs([copies(i, edits=edits) for i in range(60)])).collect()
        assert all(r.kept and r.n_removed == 0 for r in got)


def verdicts(texts, hosts):
    """The verdict by definition, over all lines of all texts."""
    lines = [[" ".join(x.lower().split()) for x in t.split("\n") if x.strip()] for t in texts]
    holders = Counter((h, x) for h, ls in zip(hosts, lines) for x in set(ls))

    def ends(x):
        w = x.split()
        n, k = len(w), min(4, len(w) // 2)
        return {tuple(w[i : i + k]) for i in (0, (n - k) // 2, n - k)} if n >= 4 else set()

    def shingles(x):
        w = x.split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    common = {x for x, n in holders.items() if n >= 20}
    known = {(h, a) for h, x in common for a in ends(x)}
    different = {}
    for i, (h, ls) in enumerate(zip(hosts, lines)):
        own = frozenset(shingles(x) for x in ls if (h, x) not in common and not any((h, a) in known for a in ends(x)))
        for x in set(ls):
            if (h, x) in common:
                different.setdefault((h, x), set()).add(own or "none")
    gone = {x for x, who in different.items() if len(who) >= 20}
    out = []
    for t, h, ls in zip(texts, hosts, lines):
        n, left = len(t.split()), sum(len(x.split()) for x in ls if (h, x) not in gone)
        _, _, _, _, again = brute(t)
        out.append((n - left, not (n < 50 or 100 * again > 50 * n) and left >= 0.3 * n))
    return out


def test_verdict_by_brute_force(docs):
    """Template pages, near copies, copies, short and plain texts on two hosts, held against the definition."""
    frame = "\n".join(" ".join(f"frame{k}x{j}" for j in range(12)) for k in range(8))
    texts = [f"{frame}\n{body(i, 20)}" for i in range(30)] + [copies(i) for i in range(40)] + [body(500 + i, 70) for i in range(20)]
    texts += [f"{frame}\n{body(600 + i, 90)}" for i in range(15)] + [copies(3)] * 25 + ["short text"] * 3
    hosts = ["a" if i % 4 else "b" for i in range(len(texts))]
    parts = {h: docs([t for t, x in zip(texts, hosts) if x == h], source=h) for h in "ab"}
    for h, df in parts.items():
        mine = [t for t, x in zip(texts, hosts) if x == h]
        got = {r.row.doc_id: (r.n_removed, r.kept) for r in quality_rules(df).collect()}
        assert [got[i] for i in range(len(mine))] == verdicts(mine, [h] * len(mine))


def test_very_long_text(docs):
    text = "\n".join(body(i, 200) for i in range(1500))
    got = quality_rules(docs([text, text + " x"])).collect()
    assert all(r.kept and r.quality.n_words >= 300_000 for r in got)


def test_lines_count_by_host(docs):
    frame = " ".join(f"frame{k}" for k in range(40))
    parts = [docs([f"{frame}\n{body(100 * h + i)}" for i in range(15)], source=f"host{h}") for h in range(2)]
    got = quality_rules(parts[0].unionByName(parts[1])).collect()
    assert len(got) == 30 and all(r.n_removed == 0 for r in got)


def test_empty_table(docs):
    assert quality_rules(docs([]).where("false")).collect() == []
