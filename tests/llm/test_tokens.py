import random
from array import array
from zlib import crc32

import public_tokenizers
import pytest
import zstandard
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidecast.llm import tokenfile as T
from tidecast.llm.files import open_file
from tidecast.llm.packing import Packer, Example, pack_documents
from tidecast.llm.tokenizing import Encoder, PieceEncoder

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library(path):
    plain, r = Tokenizer.from_file(path), random.Random(1)
    texts = ["", "a  b", "a\n b  c", "it's 'S", "don't.x", "a.,b", "x\x1c y", "<|endoftext|> a", " lead", "trail ", "Σας ΣΑΣ. İx", "日本語 。x", "a\u0085b", "o'. 's"]
    texts += ["".join(r.choice("ab 'sStT.,!?\n\t 12éß́_-\x85 <|") for _ in range(r.randint(1, 25))) for _ in range(3000)]
    held = Encoder(path, words_held=200, words_met=100)
    assert held.spell is not None
    for t in texts:
        assert held.bytes_of(t) == array("I", plain.encode(t, add_special_tokens=False).ids).tobytes(), t


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_specials_as_plain_text(path):
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    held = Encoder(path, plain_specials=True)
    for t in ("<|endoftext|> a", " x<|endoftext|>", "<|startoftext|>y", "a <| b"):
        assert held.bytes_of(t) == array("I", plain.encode(t, add_special_tokens=False).ids).tobytes(), t


def test_piece_encoder_equals_the_library():
    path, r = public_tokenizers.path("piece_bpe_32k.model"), random.Random(2)
    held, plain = PieceEncoder(path, words_held=100, words_met=50), SentencePieceProcessor(model_file=path)
    assert held.cut
    texts = ["", " ", "  ", "a  b", " a", "a ", "▁", "▁ a▁b", "<s> </s> <unk> <0x41>", "日本 語", "\n\n a\tb", "１２ ﬁ", "e\u0301 \u3000x"]
    texts += ["".join(r.choice("ab the sSTo.,!\n\t 12éß▁<> ") for _ in range(r.randint(1, 40))) for _ in range(3000)]
    for t in texts:
        assert held.bytes_of(t) == array("I", plain.encode(t, num_threads=1)).tobytes(), t


def ids_of(path, text, end):
    return array("I", [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end]).tobytes()


TEXTS = ["one two three", "", None, "long " * 5000, "x", "x", "ünï çödé 😀"]


def test_token_file_round_trip(docs, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "FRAME_BYTES", 4096)
    df = docs(TEXTS, extra=True)
    index = T.write_tokens(df.repartition(3), str(tmp_path), BYTE)
    rows = sorted(T.read_tokens(index).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, text in zip(rows, TEXTS, strict=True):
        want = ids_of(BYTE, text, 0)
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(want) // 4, want)
        at += r.n_tokens
    assert T.read_checksums(index).where("doc_id = 3").first().ids_crc32 == crc32(ids_of(BYTE, TEXTS[3], 0))
    some = T.read_tokens(index.where("doc_id in (4, 6)")).collect()
    assert {r.doc_id: bytes(r.ids) for r in some} == {4: ids_of(BYTE, "x", 0), 6: ids_of(BYTE, TEXTS[6], 0)}


def test_repeated_and_null_ids_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (None, "n"), (2, "b"), (2, "a"), (1, "c")], "doc_id long, text string")
    rows = T.read_checksums(T.write_tokens(df, str(tmp_path), BYTE)).collect()
    assert sorted((r.start, r.doc_id or 0) for r in rows) == [(0, 0), (2, 1), (4, 2), (6, 2), (8, 2)]
    assert T.read_checksums(T.write_tokens(df.where("false"), str(tmp_path), BYTE)).collect() == []


def test_damage_is_noticed(docs, tmp_path):
    index = T.write_tokens(docs(TEXTS), str(tmp_path), BYTE)
    uri = index.first().file
    path = uri.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    reader = T.FrameReader(open_file(uri))
    assert len(reader.rows) >= 1
    for place, what in ((-12, "table"), (-20, "table"), (-30, "table"), (10, "frame 0")):  # checksum, size and head of the table; ids
        broken = bytearray(data)
        broken[place] ^= 1
        open(path, "wb").write(broken)
        with pytest.raises((ValueError, zstandard.ZstdError), match=f"{what}|frame|decompress"):
            T.FrameReader(open_file(uri)).frame(0)


def sound(rows, texts, tokens, segments, prompt=None):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r.start)
        want = ids_of(WORD, texts[i], 1)
        assert b"".join(bytes(r.ids) for r in parts) == want and all(r.doc_tokens == len(want) // 4 for r in parts)
        assert all(crc32(bytes(r.ids)) == r.ids_crc32 for r in parts)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(x.length for x in parts[:i]) for i in range(len(parts))]
        assert sum(r.length for r in parts) <= tokens and len(parts) <= segments
    return by_sequence


def test_packing(docs):
    r = random.Random(3)
    texts = ["w " * r.choice([1, 5, 40, 300, 3000]) for _ in range(300)] + ["", None]
    by_sequence = sound(pack_documents(docs(texts, extra=True).coalesce(1), WORD, tokens=512, with_ids=True).collect(), texts, 512, 256)
    sizes = [sum(p.length for p in parts) for parts in by_sequence.values()]
    assert sum(s < 512 for s in sizes) <= 1
    sound(pack_documents(docs(texts[:80]).coalesce(1), WORD, tokens=512, segments=3, with_ids=True).collect(), texts[:80], 512, 3)
    assert pack_documents(docs(texts).where("false"), WORD).collect() == []


def test_limits_hold_together():
    r, packer = random.Random(5), Packer(100, 5, 40)
    examples = [Example(i, bytes(4 * n), r.randint(0, n), 0, n) for i in range(400) for n in [r.randint(1, 100)]]
    for e in examples:
        packer.add(e)
    seen = {e.row: 0 for e in examples}
    for sequence in packer.sequences(end=True):
        tokens, loss = sum(e.tokens for e, _ in sequence), sum(e.loss(e.tokens) for e, _ in sequence)
        assert tokens <= 100 and len(sequence) <= 5 and loss <= 40
        for e, _ in sequence:
            seen[e.row] += e.tokens
    assert seen == {e.row: e.row_tokens for e in examples}


def test_prompts_bear_no_loss(spark):
    df = spark.createDataFrame([(i, "q " * 30, "a " * 20) for i in range(20)], "doc_id long, prompt string, text string")
    rows = pack_documents(df.coalesce(1), WORD, prompt_col="prompt", tokens=128, loss=30).collect()
    sequences = {}
    for r in rows:
        first = max(r.start, 30)
        sequences[r.sequence_id] = sequences.get(r.sequence_id, 0) + max(0, r.start + r.length - first)
    assert max(sequences.values()) <= 30 and sum(r.length for r in rows) == 20 * 51
