r"""Operator 3, chat formatting with a grammar round trip.

Grammar (``Reader`` parses it deterministically, left to right):

    conversation = turn*
    turn         = "<s>" role "\n" body "\n</s>\n"
    body         = characters, in which a control string counts only if no backslash stands before it

Rendering a turn starts from its raw text. The rendered turn is parsed again; if what comes back is not exactly
the turn, the conflicting content is escaped (one backslash before each control string, which reading takes off
again) and the turn is parsed once more, until the two are identical. In a role, backslash and line feed are written
as ``\\`` and ``\n``.

Turns are rendered where they lie, with no shuffle. Reading back sorts each conversation's turns together and
streams them: digests are updated turn by turn, so a conversation of any length takes constant memory.

Edge cases: a null text or role is empty; a null turn comes first; rows of equal turn number come in order of their
rendered text, repeated ones each; a null conversation id is one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_ANY = re.compile(r"\\*(?:" + "|".join(map(re.escape, CONTROL)) + ")")
_REAL = re.compile(r"(?<!\\)(?:" + "|".join(map(re.escape, CONTROL)) + ")")
_ROLE = {"\\\\": "\\", "\\n": "\n"}
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _ANY.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ANY.sub(lambda m: m[0].removeprefix("\\"), text)


def _written(role: str, body: str) -> str:
    return "<s>" + role.replace("\\", "\\\\").replace("\n", "\\n") + "\n" + body + "\n</s>\n"


class Reader:
    """Incremental parser: ``feed`` text, get the turns that are complete as (role, text)."""

    def __init__(self):
        self.rest = ""

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        self.rest += text
        while self.rest:
            if not self.rest.startswith("<s>"):
                if "<s>".startswith(self.rest):
                    return
                raise ValueError("a turn must begin with <s>")
            line = self.rest.find("\n")
            if line < 0:
                return
            end = _REAL.search(self.rest, line + 1)
            if not end or len(self.rest) == end.end():
                return
            if end[0] != "</s>" or end.start() == line + 1 or self.rest[end.start() - 1] != "\n" or self.rest[end.end()] != "\n":
                raise ValueError(f"control string {end[0]} out of place")
            role = re.sub(r"\\[\\n]", lambda m: _ROLE[m[0]], self.rest[3:line])
            body = self.rest[line + 1 : end.start() - 1]
            self.rest = self.rest[end.end() + 1 :]
            yield role, unescape(body)

    def close(self) -> None:
        if self.rest:
            raise ValueError("the last turn does not end")


def parse(text: str) -> list[tuple[str, str]]:
    reader = Reader()
    turns = list(reader.feed(text))
    reader.close()
    return turns


def render(role: str | None, text: str | None) -> tuple[str, bool]:
    """A turn as text, and whether its content had to be escaped."""
    turn = (role or "", text or "")
    for escaped, body in ((False, turn[1]), (True, escape(turn[1]))):
        out = _written(turn[0], body)
        try:
            if parse(out) == [turn]:
                return out, escaped
        except ValueError:
            pass
    raise ValueError("a turn does not survive its round trip")


def _render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = [render(r, t) for r, t in zip(batch["role"], batch["text"], strict=True)]
        yield pd.DataFrame({"conv_id": batch["conv_id"], "turn": batch["turn"], "rendered": [m[0] for m in made], "escaped": [m[1] for m in made]})


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, rendered, escaped. A conversation is its rendered turns in order."""
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return turns.mapInPandas(_render, "conv_id long, turn long, rendered string, escaped boolean")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    nothing = object()
    now, state = nothing, None

    def done() -> tuple:
        state["reader"].close()
        return (now, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"])

    for batch in batches:
        out = []
        for conv, rendered in zip(batch["conv_id"].astype(object).where(batch["conv_id"].notna(), None), batch["rendered"], strict=True):
            if state is None or conv != now:
                if state is not None:
                    out.append(done())
                now, state = conv, {"reader": Reader(), "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
            state["chars"] += len(rendered)
            for role, text in state["reader"].feed(rendered):
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if role == LOSS_ROLE:
                    state["loss_chars"] += len(text)
                    state["loss"].update(text.encode("utf-8", "surrogatepass"))
        if out:
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
    if state is not None:
        yield pd.DataFrame([done()], columns=names).astype({"conv_id": "Int64"})


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse the formatted conversations again; one row per conversation with digests of what was read."""
    order = formatted.select("conv_id", "turn", "rendered").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered")
    return order.mapInPandas(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
