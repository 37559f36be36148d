r"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

``format_chat`` emits numbered text segments, each with its loss flag, so a
conversation of any length streams through a task and is never gathered.
:func:`write_chat` writes them to the shared folder, and :func:`read_back` takes
them from there, in whatever order files are read. Joining a conversation's
segments gives its formatted text::

    ### User: hello</turn>
    ### Assistant: hi</turn>

Control strings inside texts are escaped with a backslash (``\###``,
``\</turn>``; a backslash itself doubles), which :func:`read_back` undoes.

Defined results: turns sort by ``turn`` (null first), then role, then text;
repeated rows are turns of their own; a null text or role is empty; a null
``conv_id`` is one conversation; roles that the template lacks are written as
``@name`` and make the conversation invalid; an empty table gives no rows.
Columns other than the four named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

START, ERROR = "start", "error"


@dataclass(frozen=True)
class Template:
    """What surrounds a turn, how each role is named, which texts carry loss and which role may follow which."""

    opening: str = "### "
    after_role: str = ": "
    closing: str = "</turn>"
    between: str = "\n"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: frozenset[str] = frozenset({"assistant"})

    def step(self, state: str, role: str) -> str:
        return role if role in self.follows.get(state, ()) else ERROR

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.opening.strip(), self.closing)

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for control in self.controls:
            if control in text:
                text = re.sub(f"(?={re.escape(control)})", r"\\", text)
        return text

    def header(self, role: str) -> str:
        name = self.names.get(role)
        if name is None:
            name = "@" + self.escape(role).replace(":", "\\:")
        return f"{self.opening}{name}{self.after_role}"

    def role_of(self, name: str) -> str:
        if name.startswith("@"):
            return unescape(name[1:])
        return {v: k for k, v in self.names.items()}[name]


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


SEGMENTS = "conv_id long, segment long, kind string, text string, loss boolean, state string"


def _ordered(conversations: DataFrame) -> DataFrame:
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chat(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments of every conversation, in order within each partition: ``conv_id, segment, kind, text, loss, state``.

    ``kind`` is ``open``, ``text`` or ``close``; ``state`` is the machine's state
    after the turn, ``error`` from the first turn that breaks the order on.
    """

    def run(batches):
        import pyarrow as pa

        conv, state, n = _NONE, START, 0
        for b in batches:
            out: list[tuple] = []
            for c, role, text in zip(*(b[k].to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if c != conv or conv is _NONE:
                    conv, state, n = c, START, 0
                if state != ERROR:
                    state = template.step(state, role)
                out.append((c, n, "open", template.header(role), False, state))
                out.append((c, n + 1, "text", template.escape(text), role in template.loss, state))
                out.append((c, n + 2, "close", template.closing + template.between, False, state))
                n += 3
            cols = zip(*out, strict=True) if out else ((),) * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["conv_id", "segment", "kind", "text", "loss", "state"])

    return _ordered(conversations).mapInArrow(run, SEGMENTS)


def write_chat(conversations: DataFrame, template: Template = Template(), path: str | None = None) -> DataFrame:
    """Write the segments of every conversation as Parquet to ``path``, or a new one in the shared folder, and return their reader."""
    return durable(format_chat(conversations, template), "chat", path)


_NONE = object()


class _Reader:
    """Reads formatted text of one conversation piece by piece and digests what it finds."""

    def __init__(self, template: Template):
        self.t = template
        marks = "|".join(re.escape(m) for m in (template.closing, template.after_role))
        self.token = re.compile(rf"\\.|{marks}", re.S)
        self.turns, self.lost = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted = 0
        self.valid, self.state = True, START
        self.buffer, self.loss = "", []

    def feed(self, piece: str, loss: bool) -> None:
        self.formatted += len(piece)
        self.buffer += piece
        if loss:
            self.loss.append(piece)
        end = self.t.closing + self.t.between
        if not loss and piece.endswith(end):
            before = self.buffer[: -len(end)]
            if (len(before) - len(before.rstrip("\\"))) % 2 == 0:  # else the closing is escaped, part of a text
                self._turn()

    def _turn(self) -> None:
        """The buffer holds one whole turn: opening, name, after_role, text, closing."""
        t, s = self.t, self.buffer
        if not s.startswith(t.opening):
            raise ValueError("a turn does not begin with its mark")
        at, name = len(t.opening), None
        for m in self.token.finditer(s, at):
            if m[0] == t.after_role and name is None:
                name, at = s[at : m.start()], m.end()
            elif m[0] == t.closing:
                if name is None or s[m.end() :] != t.between:
                    raise ValueError("an unescaped control string in a text")
                role, text = t.role_of(name), unescape(s[at : m.start()])
                break
        else:
            raise ValueError("a turn without an end")
        self.turns.update(f"{role}\n{text}\n".encode())
        lost = unescape("".join(self.loss))
        self.lost.update(lost.encode())
        self.loss_chars += len(lost)
        self.n_turns += 1
        self.state = t.step(self.state, role) if self.state != ERROR else ERROR
        self.buffer, self.loss = "", []

    def row(self, conv) -> tuple:
        return (conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.lost.hexdigest(), self.formatted, self.state in self.t.final)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Parse formatted segments, as :func:`format_chat` makes or :func:`write_chat` writes them, and digest each conversation.

    Roles, turns and texts come from the formatted text itself; of the other columns, ``segment``
    gives the order and ``loss`` the mask.
    """

    def run(batches) -> Iterator:
        conv, reader, out = _NONE, None, []
        for b in batches:
            for c, text, loss in zip(*(b[k].to_pylist() for k in ("conv_id", "text", "loss")), strict=True):
                if c != conv or conv is _NONE:
                    if reader:
                        out.append(reader.row(conv))
                    conv, reader = c, _Reader(template)
                reader.feed(text, loss)
            if len(out) > 1000:
                yield _digests(out)
                out = []
        if reader:
            out.append(reader.row(conv))
        yield _digests(out)

    ordered = segments.select("conv_id", "segment", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInArrow(run, DIGEST)


def _digests(rows):
    import pyarrow as pa

    cols = zip(*rows, strict=True) if rows else ((),) * 7
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])
