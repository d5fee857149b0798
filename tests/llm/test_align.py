import random
from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidecast.llm import align
from tidecast.llm.tokenizing import byte_letters

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def brute(texts):
    """Rows and pair counts by definition, token by token."""
    a, b = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    letters, names = {c: x for x, c in byte_letters().items()}, {i: e for e, i in a.get_vocab().items()}
    rows, counts = [], Counter()
    for text in texts:
        a_ids = a.encode(" " + text, add_special_tokens=False).ids if text else []
        b_ids = b.encode(text, num_threads=1) if text else []
        a_bytes = [bytes(letters[c] for c in names[i]) for i in a_ids]
        pieces = [b.id_to_piece(i) for i in b_ids]
        b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b_ids, pieces, strict=True)]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            rows.append(None)
            continue
        b_ends, at = {}, 0
        for j, x in enumerate(b_bytes):
            at += len(x)
            b_ends[at] = j
        groups, links, at, start_a, start_b = [], [], 0, 0, 0
        for i, x in enumerate(a_bytes):
            at += len(x)
            if at in b_ends:
                j = b_ends[at]
                groups.append(",".join(map(str, a_ids[start_a : i + 1])) + "|" + ",".join(map(str, b_ids[start_b : j + 1])))
                links.append((a_ids[i], b_ids[j]))
                start_a, start_b = i + 1, j + 1
        counts.update(links)
        rows.append((len(a_ids), len(b_ids), groups, links))
    best = {}
    for (_, b_id), n in counts.items():
        best[b_id] = max(best.get(b_id, 0), n)
    told = []
    for r in rows:
        if r is None:
            told.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = r
        n_best = sum(counts[x] == best[x[1]] for x in links)
        told.append((n_a, n_b, len(groups), len(links), n_best, sum(counts[x] for x in links), sha256(";".join(groups).encode()).hexdigest()))
    return told, counts


def told(df):
    return [tuple(r)[1:] for r in sorted(df.collect(), key=lambda r: r[0])]


ODD = [None, "", " ", "a", "two words", " lead", "trail ", "▁ own sign", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語 ﬁ １２", "é é", "x\n\n\ty  z", "a" * 5000, "same", "same", "w0rd-w0rd " * 3000]


@pytest.mark.parametrize("held, hot", [(500_000, 100_000), (3, 5)])
def test_equals_brute_force(docs, monkeypatch, held, hot):
    """Also where tasks pass counts on early and only a few pairs are broadcast."""
    if hot == 5:
        monkeypatch.setattr(align, "HOT_PAIRS", hot)
        monkeypatch.setattr(align, "small", lambda df, rows=0: df)
    r = random.Random(4)
    texts = ODD + ["".join(r.choice("ab the sSTo.,!\n\t 12éß▁<|>日 ") for _ in range(r.randint(1, 80))) for _ in range(60)]
    rows, pairs = align.align_tokenizers(docs(texts, extra=True).repartition(3), BYTE, PIECE)
    want, counts = brute(texts)
    assert told(rows) == want
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    assert {(p.a, p.b): (p.links, p.best) for p in pairs.collect()} == {x: (n, n == best[x[1]]) for x, n in counts.items()}


def test_whole_table(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    assert told(align.op11_tokenizer_alignment(spark, SF)) == brute(texts)[0]


def test_identity_map_holds_entries_of_equal_bytes():
    own = align.sides(BYTE, PIECE)
    met = [(a, b) for a, b in enumerate(own.same.tolist()) if b >= 0]
    assert len(met) > 10_000 and all(own.a_bytes[a] == own.b_bytes[b] for a, b in met)


def test_null_and_repeated_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "x y"), (1, "x y"), (1, "x y")], "doc_id long, text string")
    rows = align.align_tokenizers(df, BYTE, PIECE)[0].collect()
    assert len(rows) == 3 and len({tuple(r)[1:] for r in rows}) == 1 and rows[0].count_sum == 6
    assert align.align_tokenizers(df.where("false"), BYTE, PIECE)[0].collect() == []
    nothing = align.align_tokenizers(df.withColumn("text", df.text.substr(0, 0)), BYTE, PIECE)
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in nothing[0].collect()) and nothing[1].collect() == []
