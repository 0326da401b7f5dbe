"""Chat formatting with typed content parts.

A message's content is a list of parts: text, image, audio or document. A visitor flattens it in order: text is
escaped, the others become placeholders, each with an attachment reference and the number of tokens that it
expands to. A template marks the turns; what the model shall learn, the assistant's text without its markers, is
under the loss mask as a span of the turn's segment. A conversation's formatted text is its segments in order.

Control strings inside texts are made harmless by a backslash behind their first character, and those that already
look so get one more, so taking one away gives back the text whatever it held.

Formatting works row by row; reading back streams the segments sorted by conversation and turn, and keeps only
running digests, so a conversation of any length needs no more memory than one of its turns.

Defined cases: null text or content is empty; a null role is none; unknown roles are written out (escaped); unknown
part types raise ValueError; turns are ordered by turn (null first), equal ones by role and text; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
OPEN = {"user": "[INST] ", "assistant": "[ANS] ", "system": "[SYS] "}
CLOSE = {"user": " [/INST]", "assistant": "</s>", "system": " [/SYS]"}
ROLE_OPEN, ROLE_CLOSE, TURN_CLOSE = "[ROLE]", "[/ROLE]", "[/TURN]"
PLACEHOLDERS = {"image": "[IMG]", "audio": "[AUD]", "document": "[DOC]"}

_NAMES = r"s>|INST\]|ANS\]|SYS\]|ROLE\]|TURN\]|IMG\]|AUD\]|DOC\]"
_ESCAPE = re.compile(rf"([<\[])(\\*)(/?(?:{_NAMES}))")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*/?(?:{_NAMES}))")

PARTS = "array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
SEGMENTS = "conv_id long, turn long, role string, segment string, loss_start int, loss_end int, attachments array<struct<type:string,uri:string,at:int,tokens:int>>, expanded_tokens long"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


@dataclass
class TokenRules:
    """How many tokens attachments expand to."""

    patch: int = 28
    audio_per_second: float = 25.0
    per_page: int = 256


@dataclass
class Flattener:
    """Visits the parts of one message."""

    rules: TokenRules
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    chars: int = 0

    def visit(self, part: dict) -> None:
        handler = getattr(self, f"visit_{part['type']}", None)
        if handler is None:
            raise ValueError(f"unknown part type: {part['type']}")
        handler(part)

    def _emit(self, s: str) -> None:
        self.out.append(s)
        self.chars += len(s)

    def _attach(self, part: dict, tokens: int) -> None:
        self.attachments.append({"type": part["type"], "uri": part.get("uri"), "at": self.chars, "tokens": tokens})
        self._emit(PLACEHOLDERS[part["type"]])

    def visit_text(self, part: dict) -> None:
        self._emit(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        side = lambda n: math.ceil((n or 0) / self.rules.patch)
        self._attach(part, max(1, side(part.get("width")) * side(part.get("height"))))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, max(1, math.ceil((part.get("seconds") or 0) * self.rules.audio_per_second)))

    def visit_document(self, part: dict) -> None:
        self._attach(part, max(1, (part.get("pages") or 0) * self.rules.per_page))


def merged_texts(parts: list[dict]) -> list[dict]:
    """Neighbouring text parts as one, so no control string can arise where two meet."""
    out: list[dict] = []
    for p in parts:
        if p["type"] == "text" and out and out[-1]["type"] == "text":
            out[-1] = {"type": "text", "text": (out[-1].get("text") or "") + (p.get("text") or "")}
        else:
            out.append(p)
    return out


def format_turn(role: str | None, parts: list[dict], rules: TokenRules | None = None) -> tuple[str, int | None, int | None, list[dict]]:
    """(segment, start and end of its loss span or None, attachments with their places in the segment)."""
    f = Flattener(rules or TokenRules())
    for p in merged_texts(parts):
        f.visit(p)
    head = OPEN.get(role or "", f"{ROLE_OPEN}{escape(role or '')}{ROLE_CLOSE} ")
    body = "".join(f.out)
    for a in f.attachments:
        a["at"] += len(head)
    span = (len(head), len(head) + len(body)) if role == "assistant" else (None, None)
    return head + body + CLOSE.get(role or "", TURN_CLOSE), *span, f.attachments


def parse_turn(segment: str) -> tuple[str, str]:
    """(role, text) of a segment: the text unescaped, placeholders as they stand."""
    for role, head in OPEN.items():
        if segment.startswith(head) and segment.endswith(CLOSE[role]):
            return role, unescape(segment[len(head) : len(segment) - len(CLOSE[role])])
    if not segment.startswith(ROLE_OPEN) or not segment.endswith(TURN_CLOSE):
        raise ValueError("not a segment of this template")
    role, _, rest = segment[len(ROLE_OPEN) : -len(TURN_CLOSE)].partition(ROLE_CLOSE + " ")
    return unescape(role), unescape(rest)


def text_parts(text: Column) -> Column:
    """Plain text as a list of one part."""
    none = {k: F.lit(None) for k in ("uri", "width", "height", "seconds", "pages")}
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), *[v.alias(k) for k, v in none.items()])).cast(PARTS)


def format_turns(messages: DataFrame, rules: TokenRules | None = None) -> DataFrame:
    """A segment for each row of conv_id, turn, role and content (an array of parts; or text). No shuffle."""
    rules = rules or TokenRules()
    content = F.col("content").cast(PARTS) if "content" in messages.columns else text_parts(F.col("text"))
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), content.alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in re.split(r", (?![^<]*>)", SEGMENTS)]
        for batch in batches:
            out = []
            for conv, turn, role, content in batch.itertuples(index=False, name=None):
                role = None if role is None or role != role else role
                parts = [] if content is None else [p if isinstance(p, dict) else p.asDict() for p in content]
                segment, a, b, attached = format_turn(role, parts, rules)
                out.append((conv, turn, role, segment, a, b, attached, sum(x["tokens"] for x in attached)))
            df = pd.DataFrame(out, columns=names, dtype=object)
            yield df.astype({"conv_id": "Int64", "turn": "Int64", "loss_start": "Int32", "loss_end": "Int32", "expanded_tokens": "Int64"})

    return rows.mapInPandas(run, SEGMENTS)


def read_back(segments: DataFrame) -> DataFrame:
    """Each conversation's turns, loss text and length, from its segments and loss spans alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, n, turns, chars, loss, total, attached = None, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0
        done: list[tuple] = []
        for batch in batches:
            for conv, segment, a, b, k in batch.itertuples(index=False, name=None):
                conv = None if pd.isna(conv) else int(conv)
                if n and conv != at:
                    done.append((at, n, turns.hexdigest(), chars, loss.hexdigest(), total, attached))
                    n, turns, chars, loss, total, attached = 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0
                at, n = conv, n + 1
                role, text = parse_turn(segment)
                turns.update(f"{role}\n{text}\n".encode())
                if not pd.isna(a):
                    learnt = unescape(segment[int(a) : int(b)])
                    chars += len(learnt)
                    loss.update(learnt.encode())
                total += len(segment)
                attached += int(k)
            yield _read_frame(done)
            done = []
        if n:
            done.append((at, n, turns.hexdigest(), chars, loss.hexdigest(), total, attached))
        yield _read_frame(done)

    rows = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    return rows.select("conv_id", "segment", "loss_start", "loss_end", F.size("attachments").alias("k")).mapInPandas(run, READ)


def _read_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")]).astype({"conv_id": "Int64"})
