"""Texts cut at spaces, so that tokenizers see each distinct piece once.

Tokenizers that split a text by pattern before any merge never join characters across a single
space that stands between two non-space characters. Cutting there and encoding the pieces one by one gives
the ids of the whole text, and most pieces of a corpus are repeats, which a bounded cache answers.
"""

from __future__ import annotations

from collections.abc import Callable

#: Entries of a worker's cache before it becomes the older half and a new one starts; the longest piece that is kept.
CACHE_ENTRIES, CACHED_LENGTH = 450_000, 64
#: Entries of a word encoder's cache, unless it is given another bound: with its older half some 50 MB a worker, as it runs behind stages that have filled their executors.
WORD_ENTRIES = 160_000
#: A run of letters ends before such signs, so those after a letter at a piece's end are encoded on their own.
MARKS = ".,!?;:&*#%$|"


class Uneven(Exception):
    """A space of this text has white space (or nothing) at its side."""


class PieceCache(dict):
    """piece -> bytes of its ids; a missing piece is encoded, after ``lead``. strict: white space at a piece's ends is Uneven."""

    def __init__(self, encode: Callable[[str], bytes], lead: str, strict: bool, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.encode, self.lead, self.strict, self.entries = encode, lead, strict, entries
        self.older: dict[str, bytes] = {}
        self.after_break: PieceCache | None = None
        self.line_break = encode("\n")
        self.marks: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is not None:
            return self._keep(piece, found)
        stem = piece.rstrip(MARKS)
        if stem != piece and stem[-1:].isalpha():
            marks = piece[len(stem) :]
            if marks not in self.marks:
                if len(self.marks) > 1000:
                    self.marks.clear()
                self.marks[marks] = self.encode(marks)
            again = stem in self  # a stem seen before may come with these marks again
            found = self[stem] + self.marks[marks]
            return self._keep(piece, found) if again else found
        if self.strict and (not piece or piece[0].isspace() or piece[-1].isspace()):
            raise Uneven
        if "\n" in piece:  # between two characters that aren't white space it is a token border
            lines = piece.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                after = self if self.after_break is None else self.after_break
                return self[lines[0]] + b"".join([self.line_break + after[x] for x in lines[1:]])
        return self._keep(piece, self.encode(self.lead + piece))

    def bound(self, entries: int) -> None:
        """Sets the number of entries; what a larger bound let in goes."""
        if entries < self.entries:
            self.clear()
            self.older = {}
        self.entries = entries

    def _keep(self, piece: str, found: bytes) -> bytes:
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class SpacedEncoder:
    """For patterns in which a word takes the space before it: pieces are ' word'."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode, self.cache = encode, PieceCache(encode, " ", strict=True)
        self.cache.after_break = PieceCache(encode, "", strict=True)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        if rest and (not first or first[-1].isspace()):
            return self._merged(text)
        try:
            return self.encode(first) + b"".join(map(self.cache.__getitem__, rest))
        except Uneven:
            return self._merged(text)

    def _merged(self, text: str) -> bytes:
        """As above, but pieces at whose border white space meets a space stay together."""
        first, *rest = text.split(" ")
        out, held = [], [first]
        for piece in rest:
            before = held[-1]
            if before and not before[-1].isspace() and piece and not piece[0].isspace():
                out.append(self._one(" ".join(held)))
                held = ["", piece]
            else:
                held.append(piece)
        out.append(self._one(" ".join(held)))
        return b"".join(out)

    def _one(self, chunk: str) -> bytes:
        if chunk[:1] == " " and len(chunk) > 1 and not chunk[1].isspace() and not chunk[-1].isspace():
            return self.cache[chunk[1:]]
        return self.encode(chunk)


class WordEncoder:
    """For patterns that drop white space: every piece stands alone."""

    def __init__(self, encode: Callable[[str], bytes], entries: int = WORD_ENTRIES):
        self.cache = PieceCache(encode, "", strict=False, entries=entries)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, text.split(" ")))
