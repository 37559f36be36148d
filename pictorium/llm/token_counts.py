r"""Edit-aware token counts: a segment tree over each document's pre-tokens.

A document's leaves are blocks of BLOCK pre-tokens: their text and numbers of characters, pre-tokens
and tokens; inner nodes hold sums. An edit goes down the tree to the block that holds the character
CONTEXT before it (no boundary at that block's start has looked as far as the edit), takes blocks from
there until a pre-token of the new text begins where an old block after the edit does, encodes what lies
between, and updates the sums above the blocks it touched. Everything else keeps its counts and is not
copied, so an edit of a long text costs what an edit of a short one does.

:func:`build_trees` makes the leaves of every document to be stored, and :func:`apply_edits` edits
stored ones.

Edits are ``start, end, text`` in code points of the text as the edits before them left it. Bounds
outside the text are moved to its ends.

Defined results: a null text is empty and counts 0; null edits are none; a null replacement is
empty; repeated rows are counted each; an empty table gives no rows. Columns other than those named
are ignored.
"""

from __future__ import annotations

import base64
import functools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Fixed value: the pre-token pattern of the byte-level BPE file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
TIKTOKEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTEXT = 2
BLOCK = 32
MOST_KNOWN = 300_000
#: What the redaction query replaces: mail addresses, long runs of digits and long hexadecimal strings.
REDACTED = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\b(?=[0-9A-Fa-f]*\d)[0-9A-Fa-f]{16,}\b|\+?\d(?:[ -]?\d){6,}")
MARK = "<redacted>"


class Counter:
    """Pre-tokens and their numbers of tokens, for a tiktoken ranks file; remembers a bounded number of pre-tokens."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=TIKTOKEN_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def tokens(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(piece) <= 64:
                if len(self.known) >= MOST_KNOWN:
                    self.known.clear()
                self.known[piece] = n
        return n

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)


class Tree:
    """Sums of characters, pre-tokens and tokens over the leaves of a binary tree."""

    def __init__(self, *leaves: list[int]):
        self.n = max(1, len(leaves[0]))
        self.width = 1 << (self.n - 1).bit_length()
        self.sums = []
        for x in leaves:
            s = [0] * self.width + x + [0] * (self.width - len(x))
            for i in range(self.width - 1, 0, -1):
                s[i] = s[2 * i] + s[2 * i + 1]
            self.sums.append(s)
        self.chars = self.sums[0]

    @property
    def totals(self) -> list[int]:
        return [s[1] for s in self.sums]

    @property
    def leaves(self) -> list[list[int]]:
        return [s[self.width : self.width + self.n] for s in self.sums]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one beyond the end) and where it begins."""
        node, before, chars = 1, 0, self.chars
        while node < self.width:
            node *= 2
            if at - before >= chars[node] and chars[node + 1]:
                before += chars[node]
                node += 1
        return node - self.width, before

    def update(self, leaf: int, values: tuple[int, ...]) -> None:
        for s, v in zip(self.sums, values, strict=True):
            node = self.width + leaf
            change = v - s[node]
            while change and node:
                s[node] += change
                node //= 2


class CountedText:
    """A text with its tree; ``edit`` keeps both in step and says how many pre-tokens it encoded."""

    def __init__(self, text: str, counter: Counter, leaves: tuple[list[int], ...] | None = None):
        self.counter = counter
        if leaves is None:
            self._build(counter.split(text))
        else:
            self.tree, self.blocks, at = Tree(*leaves), [], 0
            for n in leaves[0] or [0]:
                self.blocks.append(text[at : at + n])
                at += n

    def _build(self, pieces: list[str]) -> None:
        parts = [pieces[i : i + BLOCK] for i in range(0, len(pieces), BLOCK)]
        self.blocks = ["".join(p) for p in parts] or [""]
        self.tree = Tree([len(x) for x in self.blocks][: len(parts)], [len(p) for p in parts], [sum(map(self.counter.tokens, p)) for p in parts])

    @property
    def text(self) -> str:
        return "".join(self.blocks)

    @property
    def n_tokens(self) -> int:
        return self.tree.totals[2]

    def edit(self, start: int, end: int, new: str | None) -> int:
        tree, blocks = self.tree, self.blocks
        length, new = tree.chars[1], new or ""
        start = min(max(start, 0), length)
        end = min(max(end, start), length)
        first, at = tree.find(max(0, start - CONTEXT))
        last, last_at = tree.find(end)
        spare = 2
        while True:
            stop = min(len(blocks), last + 1 + spare)
            old = "".join(blocks[first:stop])
            text = old[: start - at] + new + old[end - at :]
            shift, whole = len(text) - len(old), stop == len(blocks)
            # where old blocks after the edit begin, in the new text
            begins, place = {}, last_at - at + len(blocks[last])
            for b in range(last + 1, stop):
                if blocks[b]:
                    begins.setdefault(place + shift, b)
                place += len(blocks[b])
            fresh, next_ = [], len(blocks) if whole else None
            for m in self.counter.pattern.finditer(text):
                s = m.start()
                # a boundary has looked at two characters after it at most
                if s in begins and (whole or s + CONTEXT <= len(text)):
                    next_ = begins[s]
                    break
                fresh.append(m[0])
            if next_ is not None:
                break
            spare *= 2
        blocks[first] = "".join(fresh)
        tree.update(first, (len(blocks[first]), len(fresh), sum(map(self.counter.tokens, fresh))))
        for b in range(first + 1, next_):
            if blocks[b]:
                blocks[b] = ""
                tree.update(b, (0, 0, 0))
        if len(fresh) > 64 * BLOCK:
            self._build(self.counter.split(self.text))
        return len(fresh)


@functools.cache
def counter_of(path: str) -> Counter:
    return Counter(path)


def redactions(text: str | None) -> list[tuple[int, int, str]]:
    """Edits that replace what REDACTED finds, last first, so that offsets hold."""
    return [(m.start(), m.end(), MARK) for m in REDACTED.finditer(text or "")][::-1]


EDITS = "array<struct<start:int,end:int,text:string>>"


def with_redactions(trees: DataFrame) -> DataFrame:
    """``trees`` with the column ``edits``."""

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
        for b in batches:
            edits = [[{"start": s, "end": e, "text": t} for s, e, t in redactions(x)] for x in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(edits, kind)], names=[*b.schema.names, "edits"])

    return trees.select(*TREE).mapInArrow(run, f"{TREES}, edits {EDITS}")


TREE = ["doc_id", "text", "chars", "pieces", "tokens"]
TREES = "doc_id long, text string, chars array<int>, pieces array<int>, tokens array<int>"


def build_trees(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, text, chars, pieces, tokens``: each document with the leaves of its tree, to be stored."""

    def run(batches):
        import pyarrow as pa

        c = counter_of(ranks_path)
        for b in batches:
            leaves = [CountedText(t or "", c).tree.leaves for t in b["text"].to_pylist()]
            lists = [pa.array([x[i] for x in leaves], pa.list_(pa.int32())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text"], *lists], names=TREE)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TREES)


COUNTS = "doc_id long, n_tokens long, n_pretokens long, n_edits int, n_reencoded long, n_tokens_edited long, n_chars_edited long"


def apply_edits(rows: DataFrame, ranks_path: str, keep_trees: bool = False) -> DataFrame:
    """Token counts before and after ``edits``; ``rows``: stored trees, as :func:`build_trees` makes them, and ``edits``.

    With ``keep_trees`` also the edited ``text`` and the leaves of its tree.
    """
    schema = COUNTS + (", " + TREES.split(", ", 1)[1]) * keep_trees

    def run(batches):
        import pyarrow as pa

        c = counter_of(ranks_path)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3]
        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            out = []
            for doc, text, edits, *leaves in zip(*(b[k].to_pylist() for k in ("doc_id", "text", "edits", "chars", "pieces", "tokens")), strict=True):
                chars, pieces, tokens = map(sum, leaves)
                row = (doc, tokens, pieces, len(edits or ()), 0, tokens, chars)
                if edits or keep_trees:
                    t = CountedText(text or "", c, leaves)
                    done = sum(t.edit(e["start"], e["end"], e["text"]) for e in edits or ())
                    row = (*row[:4], done, t.n_tokens, t.tree.chars[1], *((t.text, *t.tree.leaves) if keep_trees else ()))
                out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(len(names))], names=names)

    return rows.select("doc_id", "text", "edits", "chars", "pieces", "tokens").mapInArrow(run, schema)


def redacted_counts(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Token counts of every document before and after its redactions, by edits of its stored tree."""
    return apply_edits(with_redactions(durable(build_trees(docs, ranks_path), "trees")), ranks_path)
