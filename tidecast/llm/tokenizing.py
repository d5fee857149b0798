"""Token ids of texts by a tokenizer file, with the ids of words met before kept at hand."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache

#: Words met twice whose ids a worker keeps, and words met once; of the latter the older half goes when they are full.
WORDS_HELD, WORDS_MET = 400_000, 200_000
#: Latin letters, and marks of which runs are tokens of their own behind a word and before white space.
LETTER, MARK = "A-Za-zÀ-ÖØ-öø-ÿ", ".,!?;:"
#: A word of Latin letters with the space before it; marks behind it; other words; white space before the last of a run.
#: No token of the tokenizers used here spans two of these.
PIECE = re.compile(rf" ?[{LETTER}]+(?=[\s{MARK}]|$)|[{MARK}]+(?=\s|$)| ?\S+|\s+(?!\S)|\s")
#: The same for a vocabulary that knows the space alone as white space, and writes it as the other sign here.
SPACED = re.compile("[ ▁]*[^ ▁]+|[ ▁]+")
#: Characters that Python and the tokenizers do not both take for white space.
ODD = re.compile("[\x1c-\x1f]")
#: One token before merging, so that the merges alone can be asked for.
LETTERS = re.compile(f" ?[{LETTER}]+")
SAMPLES = (" Word", "word", " über", "Éa", " ß", " THE", "of")


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(others)}}


BYTE_LETTERS = byte_letters()
#: How a tokenizer may spell a word for its merges: any word, and one of ASCII letters after a space or none.
SPELLINGS = (
    (lambda w: w.encode().decode("latin-1").translate(BYTE_LETTERS), lambda w: w.replace(" ", BYTE_LETTERS[32])),
    (lambda w: w.strip().lower().encode().decode("latin-1").translate(BYTE_LETTERS), lambda w: w.strip().lower()),
)


def packed(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes()


class Held:
    """The ids of the pieces that a text is cut into, kept for the next text; one pass, then only the gaps are filled.

    Most words of a corpus occur once. They wait apart, so that the words in use stay few and quick to find.
    """

    pieces = PIECE

    def __init__(self, words_held: int, words_met: int) -> None:
        self.held: dict[str, bytes] = {}
        self.met: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.most_held, self.most_met = words_held, words_met // 2

    def _encode(self, piece: str) -> bytes:
        raise NotImplementedError

    def _first(self, piece: str) -> bytes:
        """Ids of a piece that is not held. One met before is held from now on."""
        ids = self.met.get(piece) or self.before.get(piece)
        if ids is not None:
            if len(self.held) >= self.most_held:
                self.held.clear()
            self.held[piece] = ids
            return ids
        if len(self.met) >= self.most_met:
            self.met, self.before = {}, self.met
        ids = self.met[piece] = self._encode(piece)
        return ids

    def bytes_of(self, text: str) -> bytes:
        pieces = self.pieces.findall(text)
        found = list(map(self.held.get, pieces))
        at = -1
        try:
            while True:
                at = found.index(None, at + 1)
                found[at] = self._first(pieces[at])
        except ValueError:
            return b"".join(found)


class Encoder(Held):
    """``bytes_of(text)``: the ids that ``encode(text, add_special_tokens=False)`` gives, packed.

    With ``plain_specials`` the strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, words_held: int = WORDS_HELD, words_met: int = WORDS_MET, *, plain_specials: bool = False) -> None:
        super().__init__(words_held, words_met)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = self.plain_specials = plain_specials
        self.model = self.tokenizer.model
        known = [self._whole(w) for w in SAMPLES]
        self.spell, self.spell_ascii = next((f for f in SPELLINGS if [self._merged(f[0](w)) for w in SAMPLES] == known), (None, None))

    def _merged(self, word: str) -> bytes:
        return packed([t.id for t in self.model.tokenize(word)])

    def _encode(self, piece: str) -> bytes:
        if self.spell is not None:
            if piece.isascii():
                if (piece[1:] if piece[0] == " " else piece).isalpha():
                    return self._merged(self.spell_ascii(piece))
            elif LETTERS.fullmatch(piece):
                return self._merged(self.spell(piece))
        return self._whole(piece)

    def _whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def bytes_of(self, text: str) -> bytes:
        if ("<|" in text and not self.plain_specials) or ODD.search(text):
            return self._whole(text)
        return super().bytes_of(text)


class PieceEncoder(Held):
    """The same by a sentencepiece model that puts a space before each text.

    Pieces are cut before runs of spaces, which no entry of the vocabulary spans; a model with such entries is asked
    for whole texts.
    """

    pieces = SPACED

    def __init__(self, path: str, words_held: int = WORDS_HELD, words_met: int = WORDS_MET) -> None:
        super().__init__(words_held, words_met)
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.entries = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cut = not any("▁" in e.lstrip("▁") for e in self.entries)

    def _encode(self, piece: str) -> bytes:
        if piece in (" ", "▁"):
            return packed([self.model.piece_to_id("▁")])
        return packed(self.model.encode(piece[1:], num_threads=1))

    def bytes_of(self, text: str) -> bytes:
        if not text:
            return b""
        return super().bytes_of(" " + text) if self.cut else packed(self.model.encode(text, num_threads=1))


@lru_cache(maxsize=3)
def encoder(path: str, plain_specials: bool = False) -> Encoder:
    """One for each file in each worker."""
    return Encoder(path, plain_specials=plain_specials)


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One for each file in each worker."""
    return PieceEncoder(path)
