"""Chat formatting: a finite-state machine over roles and a declarative template.

The template says how each role's turn opens and closes, which roles may follow which state, and whose
text bears loss. The machine walks a conversation's turns in order and emits text segments, each with a
loss flag; template marks never bear loss. Control strings inside texts are escaped with a backslash, so
that formatted text can be read back exactly.

Cases: a null text is an empty one, a null role is the role ``unknown``; roles outside the template use its
``other`` marks and are invalid for the machine; conversations with a wrong turn order are formatted all
the same and carry ``valid = false`` and the first wrong turn. Rows that repeat a turn number all stay,
ordered by role and text. A conversation is streamed turn by turn from a sorted partition, never gathered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read


@dataclass(frozen=True)
class ChatTemplate:
    """``marks``: role to (opening, closing). ``moves``: state to the roles it lets in; a role is the next state."""

    start: str = "<s>"
    end: str = "<end>"
    marks: dict = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>"),
        "user": ("[INST]", "[/INST]"),
        "assistant": ("[ANS]", "</s>"),
    })
    other: tuple = ("<<ROLE>>", "<</ROLE>>")
    role_end: str = "<<:>>"
    loss_roles: tuple = ("assistant",)
    moves: dict = field(default_factory=lambda: {
        "": ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user",),
    })
    accepting: tuple = ("assistant",)

    def controls(self) -> list[str]:
        pairs = [m for two in self.marks.values() for m in two]
        return sorted({self.start, self.end, *self.other, self.role_end, *pairs}, key=lambda m: (-len(m), m))

    def escaper(self):
        """A backslash goes before every backslash and every control string of a text."""
        find = re.compile("|".join(map(re.escape, ["\\", *self.controls()])))
        return lambda text: find.sub(lambda m: "\\" + m[0], text)

    def unescaper(self):
        find = re.compile(r"\\(" + "|".join(map(re.escape, ["\\", *self.controls()])) + ")")
        return lambda text: find.sub(lambda m: m[1], text)


@dataclass
class Machine:
    """Walks the turns of one conversation: says whether each is in order and emits its segments."""

    template: ChatTemplate
    state: str = ""
    turns: int = 0
    wrong: int = -1

    def step(self, role: str, text: str, escape) -> list[tuple[str, bool]]:
        t = self.template
        if role not in t.moves.get(self.state, ()) and self.wrong < 0:
            self.wrong = self.turns
        first = [(t.start, False)] if not self.turns else []
        self.state, self.turns = role, self.turns + 1
        if role in t.marks:
            opening, closing = t.marks[role]
            head = opening
        else:
            opening, closing = t.other
            head = opening + escape(role) + t.role_end
        return [*first, (head, False), (escape(text), role in t.loss_roles), (closing, False)]

    def finish(self) -> list[tuple[str, bool]]:
        if self.wrong < 0 and self.state not in self.template.accepting:
            self.wrong = self.turns
        return [(self.template.end, False)]


def parse(segments: Iterable[tuple[str, bool]], template: ChatTemplate) -> Iterator[tuple[str, str, str]]:
    """Reads formatted output back: yields (role, text, text under the loss mask) per turn.

    The text is scanned as a stream of segments; an unescaped control string is a mark, all else is content.
    """
    token = re.compile(r"(?s)\\(?P<kept>\\|" + "|".join(map(re.escape, template.controls())) + ")|(?P<mark>" + "|".join(map(re.escape, template.controls())) + ")")
    opens = {m[0]: role for role, m in template.marks.items()}
    role, closing, content, loss = None, None, [], []
    for text, bears in segments:
        at = 0
        for m in token.finditer(text):
            if m.start() > at:
                content.append(text[at : m.start()])
                if bears:
                    loss.append(text[at : m.start()])
            at = m.end()
            mark = m["mark"]
            if mark is None:
                content.append(m["kept"])
                if bears:
                    loss.append(m["kept"])
            elif mark in opens and role is None:
                role, closing, content, loss = opens[mark], template.marks[opens[mark]][1], [], []
            elif mark == template.other[0] and role is None:
                role, closing, content, loss = "", template.other[1], [], []
            elif mark == template.role_end:
                role, content, loss = "".join(content), [], []
            elif mark == closing:
                yield role, "".join(content), "".join(loss)
                role, closing = None, None
        if at < len(text):
            content.append(text[at:])
            if bears:
                loss.append(text[at:])


def _ordered(conversations: DataFrame) -> DataFrame:
    turns = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, Iterator[tuple[str, str]]]]:
    """Turns of sorted batches as (conv_id, turns); a conversation may span batches and is never gathered."""
    rows = ((None if pd.isna(c) else int(c), r, x) for b in batches for c, r, x in zip(b["conv_id"], b["role"], b["text"], strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        conv = ahead[0]

        def turns(conv=conv):
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                yield ahead[1], ahead[2]
                ahead = next(rows, None)

        yield conv, (mine := turns())
        for _ in mine:
            pass


def format_chat(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per segment: conv_id, segment (from 0), text, loss, valid_so_far. Joined in order, the texts are the formatted conversation."""
    t = template or ChatTemplate()

    def run(batches):
        escape = t.escaper()
        for conv, turns in _conversations(batches):
            machine, out, n = Machine(t), [], 0
            for role, text in turns:
                for x, bears in machine.step(role, text, escape):
                    out.append((conv, n, x, bears, machine.wrong < 0))
                    n += 1
                if len(out) > 2000:
                    yield pd.DataFrame(out, columns=["conv_id", "segment", "text", "loss", "valid_so_far"])
                    out = []
            out += [(conv, n, x, bears, machine.wrong < 0) for x, bears in machine.finish()]
            yield pd.DataFrame(out, columns=["conv_id", "segment", "text", "loss", "valid_so_far"])

    return _ordered(conversations).mapInPandas(run, "conv_id long, segment long, text string, loss boolean, valid_so_far boolean")


def chat_digest(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Per conversation, what is read back from the formatted output, and whether the turn order is valid."""
    t = template or ChatTemplate()
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "first_wrong_turn"]

    def run(batches):
        escape, out = t.escaper(), []
        for conv, turns in _conversations(batches):
            machine, chars = Machine(t), 0

            def emitted(machine=machine, turns=turns):
                nonlocal chars
                for role, text in turns:
                    for x, bears in machine.step(role, text, escape):
                        chars += len(x)
                        yield x, bears
                for x, bears in machine.finish():
                    chars += len(x)
                    yield x, bears

            n, loss_chars, all_sha, loss_sha = 0, 0, hashlib.sha256(), hashlib.sha256()
            for role, text, loss in parse(emitted(), t):
                n += 1
                all_sha.update(f"{role}\n{text}\n".encode())
                loss_sha.update(loss.encode())
                loss_chars += len(loss)
            out.append((conv, n, all_sha.hexdigest(), loss_chars, loss_sha.hexdigest(), chars, machine.wrong < 0, machine.wrong))
            if len(out) >= 4000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    return _ordered(conversations).mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, first_wrong_turn long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    probe = spark.createDataFrame(extra, "conv_id long, turn long, role string, text string")
    conversations = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digest(conversations.unionByName(probe))


_TURNS = """turns AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))"""

#: Escapes add one character for each backslash or control string; marks are constants of the template.
SQL = f"""WITH {_TURNS},
marked AS (SELECT *, lag(role, 1, '') OVER w AS before, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM turns
 WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
rated AS (SELECT *, CASE WHEN (before = '' AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user')
 OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user') THEN NULL ELSE place END AS wrong,
 length(text) + len(regexp_extract_all(text, '\\\\|<</SYS>>|<<ROLE>>|<</ROLE>>|<<SYS>>|\\[/INST\\]|\\[INST\\]|\\[ANS\\]|<<:>>|<end>|</s>|<s>'))
 + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9
   ELSE 22 + length(role) + len(regexp_extract_all(role, '\\\\|<</SYS>>|<<ROLE>>|<</ROLE>>|<<SYS>>|\\[/INST\\]|\\[INST\\]|\\[ANS\\]|<<:>>|<end>|</s>|<s>')) END AS chars
 FROM marked),
closed AS (SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(chars) + 8 AS BIGINT) AS formatted_chars,
 CAST(coalesce(min(wrong), CASE WHEN max_by(role, place) = 'assistant' THEN -1 ELSE max(n) END) AS BIGINT) AS first_wrong_turn
 FROM rated GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, first_wrong_turn < 0 AS valid, first_wrong_turn FROM closed"""
