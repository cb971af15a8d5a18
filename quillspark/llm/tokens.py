"""Token ids of whole documents, cut losslessly into pieces of bounded length.

Encoding works on chunks between plain spaces and line feeds: the tokenizer's
rules never join text across white space.  A chunk's ids are looked up in a
bounded memory of the worker; only new words reach the byte-pair encoder.
Texts that the short cut might not treat exactly are encoded whole.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex

#: Length of a sequence and the id that ends each document.
SEQUENCE, END = 2048, 0
#: Entries of a worker's memory of chunks, and as many of what stands beside words in them.
MEMORY = 800_000

_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Only characters below U+0250 with no white space or control among them: NFC leaves these as they are.
_PLAIN = re.compile(r"[!-~¡-ɏ]*\Z")
#: Lower case that depends on the place in a word, and the start of strings that may be special tokens.
_ODD = ("<|", "İ", "Σ")


def vocabulary() -> str:
    """Path of the public vocabulary that the packing operators use by default."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memory(dict):
    """What ``find`` returned for a key; when there are too many, what was not asked for since the last time is forgotten."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self.find, self.old = find, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.find(key)
        if len(self) >= MEMORY // 2:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Encoder:
    """Documents to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary())
        self.words, self.chunks = _Memory(self._word), _Memory(self._chunk)
        self.letters, self.tokenize = _byte_letters(), self.tokenizer.model.tokenize

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(mapped)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() or _PLAIN.match(chunk):
            if chunk.isalpha():  # most chunks are one word, or one with a mark
                return self._word(chunk)
            if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
                return self.chunks[chunk[:-1]] + self.words[chunk[-1]]
            if _PLAIN.match(chunk):
                return b"".join(map(self.words.__getitem__, _WORD.findall(chunk)))
        return self.whole(chunk)

    def encode(self, text: str) -> bytes:
        if any(odd in text for odd in _ODD):
            return self.whole(text)
        return b"".join(map(self.chunks.__getitem__, text.lower().replace("\n", " ").split(" ")))


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(rows: Iterator[pa.RecordBatch], path: str | None, with_ids: bool, sequence: int = SEQUENCE) -> Iterator[pa.RecordBatch]:
    """Pieces of at most ``sequence`` tokens of each document, its end id included."""
    encoder = Encoder(path)
    end, out, size = np.array([END], dtype="<u4").tobytes(), [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PIECES, strict=True)], schema=PIECES)

    for batch in rows:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids = encoder.encode(text.as_py() or "") + end
            for piece, at in enumerate(range(0, len(ids), 4 * sequence)):
                part = ids[at : at + 4 * sequence]
                out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                size += len(part) * with_ids + 40
                if size > 4 << 20:
                    yield flush()
                    out, size = [], 0
    if out:
        yield flush()
