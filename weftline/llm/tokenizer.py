"""Worker-side tokenizers by file path, each loaded once per Python worker."""

from __future__ import annotations

import functools
from array import array

from weftline.llm.pieces import WORD_ENTRIES, SpacedEncoder, WordEncoder


@functools.cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


#: Words on which the short way below must agree with the tokenizer before it is used.
TRIED = ("the", "The", "THE", "internationalisation", "qzxv", "a", "Zz", "wordwordwordword", "ñandú", "ÉTÉ", "größe", "façon", "ßµªº")


def _byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is printable, else the next from 256 on."""
    out, spare = [], 256
    for byte in range(256):
        printable = 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174
        out.append(chr(byte if printable else spare))
        spare += not printable
    return out


BYTE_CHARACTERS = str.maketrans(dict(enumerate(_byte_characters())))


def byte_level(text: str) -> str:
    return text.encode().decode("latin-1").translate(BYTE_CHARACTERS)


def _ids(path: str, shape, shape_ascii):
    """piece -> bytes of its ids. A run of Latin-1 letters is one pre-token, which goes to the tokenizer's model directly;
    ``shape`` gives it the form that the normaliser and pre-tokenizer would, ``shape_ascii`` does so for ASCII letters (of a
    piece, and the piece without a leading space)."""
    encode, tokenize = tokenizer(path).encode, tokenizer(path).model.tokenize

    def whole(piece: str) -> bytes:
        return array("I", encode(piece, add_special_tokens=False).ids).tobytes()

    def short(piece: str) -> bytes:
        word = piece[1:] if piece[:1] == " " else piece
        if word.isalpha():
            if word.isascii():
                return array("I", [token.id for token in tokenize(shape_ascii(piece, word))]).tobytes()
            if max(word) <= "ÿ":
                return array("I", [token.id for token in tokenize(shape(piece))]).tobytes()
        return whole(piece)

    agree = all(short(x) == whole(x) for word in TRIED for x in (word, " " + word))
    return short if agree else whole


@functools.cache
def spaced_encoder(path: str) -> SpacedEncoder:
    """text -> little-endian unsigned 32-bit ids, for byte-level files whose pattern keeps spaces."""
    return SpacedEncoder(_ids(path, byte_level, lambda piece, word: word if word is piece else BYTE_CHARACTERS[32] + word))


@functools.cache
def _word_encoder(path: str) -> WordEncoder:
    return WordEncoder(_ids(path, lambda piece: byte_level(piece.strip().lower()), lambda _, word: word.lower()))


def word_encoder(path: str, entries: int = WORD_ENTRIES) -> WordEncoder:
    """text -> little-endian unsigned 32-bit ids, for files whose pattern drops white space. entries: the bound of its cache from now on."""
    found = _word_encoder(path)
    found.cache.bound(entries)
    return found


@functools.cache
def vocabulary_size(path: str) -> int:
    return tokenizer(path).get_vocab_size(with_added_tokens=True)


@functools.cache
def sentence_end_ids(path: str):
    """A table over ids: true where the token ends a sentence (its string ends in . ! or ?)."""
    import numpy as np

    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    table = np.zeros(max(vocab.values(), default=0) + 1, bool)
    for word, i in vocab.items():
        table[i] = word.removesuffix("</w>")[-1:] in {".", "!", "?"}
    return table
