"""Encoding whole texts with a public tokenizer file, a distinct word at a time.

A tokenizer whose pre-tokenizer drops white space encodes each run of other
characters by itself, so the ids of a text are the ids of its blank-separated
pieces, joined; a letter and a punctuation mark after it never share a token
either. A batch's pieces are made distinct by Arrow, a table of bounded size
answers most of the distinct ones, and the rest go to the library. The table
has two generations: when the young one is full it replaces the old one, so
memory does not grow with the corpus. Any other tokenizer file gets the
library's call on whole texts.
"""

from __future__ import annotations

import json
import os
from unicodedata import is_normalized

GENERATION = 500_000
LONGEST_KEPT = 64
MARKS = ".,!?;:*$%&|<>#"
#: Fixed rule of byte-level BPE files: bytes that print stand for themselves, the others for 256, 257, ...
PRINTING = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b) for b in PRINTING} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in PRINTING)}


class _Pieces(dict):
    """Piece of text to its ids (little-endian unsigned 32-bit)."""

    def __init__(self, tokenizer, lowers: bool):
        super().__init__({"": b""})
        self.tokenizer, self.lowers, self.old = tokenizer, lowers, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self._make(piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= GENERATION:
                self.old = dict(self)
                self.clear()
                self[""] = b""
            self[piece] = ids
        return ids

    def _make(self, piece: str) -> bytes:
        core = piece.rstrip(MARKS)
        if core and core != piece and core[-1].isalpha() and is_normalized("NFC", piece) and "<|" not in piece:
            return self[core] + self[piece[len(core) :]]
        if self.lowers and piece.isalpha():
            if piece.isascii() and not piece.islower():
                return self[piece.lower()]
            if piece.islower() and is_normalized("NFC", piece):  # one pre-token that normalising leaves alone
                letters = piece if piece.isascii() else "".join(map(BYTE_LETTERS.__getitem__, piece.encode()))
                return _bytes([t.id for t in self.tokenizer.model.tokenize(letters)])
        return _bytes(self.tokenizer.encode(piece, add_special_tokens=False).ids)


def _bytes(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


class WordCodec:
    """``encode`` gives the ids of a list of texts, flat, and the offsets of the texts; null counts as empty."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        pre = settings.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers") or [pre]
        self.by_piece = parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True and r"[^\s\p{L}\p{N}]+" in str(parts[0].get("pattern", {}).get("Regex"))
        steps = {x.get("type") for x in (settings.get("normalizer") or {}).get("normalizers", [])}
        self.pieces = _Pieces(self.tokenizer, "Lowercase" in steps and steps <= {"NFC", "Replace", "Lowercase"} and any(p.get("type") == "ByteLevel" for p in parts))

    def whole(self, text: str | None) -> bytes:
        """The library's own answer for one text."""
        return _bytes(self.tokenizer.encode(text or "", add_special_tokens=False).ids)

    def encode(self, texts):
        """``texts``: a list or an Arrow array. Returns uint32 ids and int64 offsets, one more than texts."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        offsets = np.zeros(len(texts) + 1, np.int64)
        if not self.by_piece:
            each = [self.whole(t) for t in texts.to_pylist()]
            np.cumsum([len(b) // 4 for b in each], out=offsets[1:])
            return np.frombuffer(b"".join(each), "<u4"), offsets
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        values = list(map(self.pieces.__getitem__, coded.dictionary.to_pylist()))
        table = np.frombuffer(b"".join(values), "<u4")
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        starts = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy(zero_copy_only=False)
        per_word = sizes[codes]
        ends = np.cumsum(per_word)
        ids = table[np.repeat(starts[codes] - (ends - per_word), per_word) + np.arange(ends[-1] if len(ends) else 0)]
        words = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
        offsets[:] = np.concatenate(([0], ends))[words]
        return ids, offsets
