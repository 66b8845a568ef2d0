"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document.  A
visitor flattens them, in order, into one string: text is escaped, any other
part becomes a numbered placeholder, recorded with its reference and the
number of tokens that it will expand to.  A part of a kind that has no visit
of its own is recorded too, as ``other``, and expands to no token unless it
says how many.  The template marks turns with
control strings; the escape makes it impossible for a text to hold one, and
is undone exactly by :func:`read_back`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"

#: Tokens that a part expands to where the part itself doesn't say.
DEFAULT_TOKENS = {"image": 256, "audio": 128, "document": 512, "other": 0}

_MARK = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>((?:[^\n\\]|\\.)*)\n(.*?)<\|im_end\|>\n", re.S)
_SLOT = re.compile(r"<\|(image|audio|document|other):(\d+)\|>")


def escape(text: str) -> str:
    """One backslash more between ``<`` and ``|``: the result never holds ``<|``."""
    return _MARK.sub(lambda m: "<\\" + m[1] + "|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "<" + m[1] + "|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S))


@dataclass
class Flattener:
    """Visits the parts of one conversation; keeps what they leave behind."""

    pieces: list[str] = field(default_factory=list)
    at: int = 0
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def put(self, text: str) -> None:
        self.pieces.append(text)
        self.at += len(text)

    def visit(self, turn: int, part: dict) -> None:
        kind = part.get("kind") or "text"
        getattr(self, f"visit_{kind}", self.visit_unknown)(turn, part)

    def visit_text(self, turn: int, part: dict) -> None:
        self.put(escape(part.get("text") or ""))

    def visit_image(self, turn: int, part: dict) -> None:
        self._attach("image", turn, part)

    def visit_audio(self, turn: int, part: dict) -> None:
        self._attach("audio", turn, part)

    def visit_document(self, turn: int, part: dict) -> None:
        self._attach("document", turn, part)

    def visit_unknown(self, turn: int, part: dict) -> None:
        self._attach("other", turn, part)

    def _attach(self, kind: str, turn: int, part: dict) -> None:
        slot = len(self.attachments)
        tokens = part.get("tokens")
        self.attachments.append(
            {"slot": slot, "turn": turn, "kind": kind, "ref": part.get("ref"), "at": self.at, "tokens": DEFAULT_TOKENS[kind] if tokens is None else tokens}
        )
        self.put(f"<|{kind}:{slot}|>")


def flatten(turns: list[tuple[str, list[dict]]], loss_role: str = "assistant") -> Flattener:
    """The formatted conversation; ``loss``: spans of code points of each turn of ``loss_role``, without marks."""
    out = Flattener()
    for k, (role, parts) in enumerate(turns):
        out.put(f"{START}{escape_role(role)}\n")
        begin = out.at
        for part in parts:
            out.visit(k, part)
        if role == loss_role:
            out.loss.append((begin, out.at))
        out.put(END)
    return out


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, unescaped; placeholders of other parts are left out."""
    return [(unescape_role(m[1]), unescape(_SLOT.sub("", m[2]))) for m in _TURN.finditer(formatted)]


def under_mask(formatted: str, loss: list[tuple[int, int]]) -> list[str]:
    """The unescaped text of each loss span, without placeholders."""
    return [unescape(_SLOT.sub("", formatted[a:b])) for a, b in loss]


SCHEMA = (
    "formatted string, loss array<struct<start:long,end:long>>, "
    "attachments array<struct<slot:int,turn:int,kind:string,ref:string,at:long,tokens:long>>, attachment_tokens long"
)


def format_conversations(
    df: DataFrame, conv_col: str, turn_col: str, role_col: str, *, text_col: str | None = None, parts_col: str | None = None, loss_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: (id, formatted, loss, attachments, attachment_tokens).

    Content is ``parts_col`` (array of structs with any of kind, text, ref,
    tokens) or else ``text_col``, one text part a turn.  Turns go by
    ``turn_col``, nulls first, ties by role, then content; repeated rows are
    repeated turns.  Null texts, parts and roles are empty.  Rows of a null
    conversation id form one conversation; ids are whole numbers.  Parts of
    unknown kind become placeholders of the kind ``other``.  Texts are taken
    whole, however long.  An empty table gives an empty
    result.  Other columns are neither read nor returned.  A conversation is
    one output value, so one task assembles it.
    """
    content = F.col(parts_col) if parts_col else F.array(F.struct(F.lit("text").alias("kind"), F.col(text_col).cast("string").alias("text")))
    rows = df.select(F.col(conv_col).cast("long").alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), content.alias("parts")).alias("t"))
    grouped = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def run(batches):
        for batch in batches:
            out = []
            for turns in batch.column("turns"):
                f = flatten([(t["role"], [p for p in t["parts"] or [] if p]) for t in turns.as_py()], loss_role)
                out.append(
                    {
                        "formatted": "".join(f.pieces),
                        "loss": [{"start": a, "end": b} for a, b in f.loss],
                        "attachments": f.attachments,
                        "attachment_tokens": sum(a["tokens"] for a in f.attachments),
                    }
                )
            made = pa.Table.from_pylist(out, ARROW).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), *(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in made.columns)], ["conv", *made.column_names]
            )

    return grouped.mapInArrow(run, f"conv long, {SCHEMA}").withColumnRenamed("conv", conv_col)


ARROW = pa.schema(
    [
        ("formatted", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        (
            "attachments",
            pa.list_(pa.struct([("slot", pa.int32()), ("turn", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])),
        ),
        ("attachment_tokens", pa.int64()),
    ]
)
