"""Secret scans: fixed patterns, plus sliding-window Shannon entropy over candidate strings.

Candidates are runs of ``[A-Za-z0-9+/_=-]`` of at least ``min_run`` characters. A window of ``window``
characters slides over each; its entropy is kept by incremental counts (one character in, one out) and
compared with the threshold of the window's character class (hexadecimal, letters and digits of one case,
or base64) if it has digits; a window of any class, with or without digits, is hot too if many of its pairs of
neighbours are none that words have. Adjoining hot windows are merged to one span of kind ``entropy``. Runs that an
allow-list pattern covers are suppressed; of a span that fixed patterns found in part the rest is kept.

Cases: null and empty texts have no spans; texts of any length are scanned whole; all offsets are code
points, ends exclusive. Long runs cost time in proportion to their length. Repeated rows are scanned each;
a null doc_id stays null.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .shared import read, with_id, with_null_id

# The patterns of the base kinds, in the order in which ties are listed.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class EntropyRule:
    """Thresholds are bits per character over a window; classes are tried from the narrowest."""

    window: int = 20
    min_run: int = 20
    hex_bits: float = 3.0
    alnum_bits: float = 3.7
    base64_bits: float = 4.0
    min_digits: int = 3
    random_bits: float = 3.0  # with so many bits and ``odd_pairs`` a window is hot by its pairs
    odd_pairs: int = 8
    allow: tuple = (
        r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",  # UUIDs name things, they don't open them
        r"(?i:[\w+/=-]*(?:example|placeholder|changeme|your[_-]?key)[\w+/=-]*)",
        r"[0-9+/_=-]+",  # no letter: numbers, dates, rules
    )


_DIGITS, _LOWER, _UPPER = set("0123456789"), set("abcdefghijklmnopqrstuvwxyz"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = _DIGITS | set("abcdefABCDEF")


def hot_windows(run: str, rule: EntropyRule) -> Iterator[tuple[int, int]]:
    """Merged (start, end) of the windows of ``run`` whose entropy passes the threshold of their class.

    H = log2(w) - sum(c log2 c)/w over the window's counts; the sum and the class counts are kept up to date
    as one character leaves and one enters.
    """
    w = rule.window
    cost = [0.0] + [c * math.log2(c) for c in range(1, w + 1)]
    counts: dict[str, int] = {}
    total, digits, others, lower, upper, nonhex = 0.0, 0, 0, 0, 0, 0
    start = end = None
    for i, c in enumerate(run):
        for ch, d in ((run[i - w], -1), (c, 1)) if i >= w else ((c, 1),):
            before = counts.get(ch, 0)
            counts[ch] = before + d
            total += cost[before + d] - cost[before]
            digits += d * (ch in _DIGITS)
            lower += d * (ch in _LOWER)
            upper += d * (ch in _UPPER)
            nonhex += d * (ch not in _HEX)
            others += d * (ch not in _DIGITS and ch not in _LOWER and ch not in _UPPER)
        if i < w - 1:
            continue
        bits = math.log2(w) - total / w
        if digits < rule.min_digits or lower + upper == 0:
            hot = False
        elif nonhex == 0:
            hot = bits >= rule.hex_bits
        elif others == 0 and (lower == 0 or upper == 0):
            hot = bits >= rule.alnum_bits
        else:
            hot = bits >= rule.base64_bits
        if hot:
            if start is not None and i - w + 1 <= end:
                end = i + 1
            else:
                if start is not None:
                    yield start, end
                start, end = i - w + 1, i + 1
    if start is not None:
        yield start, end


#: Letters that follow a letter in words of the Latin script.
_FOLLOW = {
    "a": "bcdgilmnprstuvy", "b": "aeiloruy", "c": "aehiklortu", "d": "aeiorsuy", "e": "abcdefghilmnprstuvwxy", "f": "aefilortu", "g": "aehilnorsu",
    "h": "aeilnortu", "i": "acdefglmnoprstvz", "j": "aeou", "k": "aeilnost", "l": "adeilostuy", "m": "abeimopuy", "n": "acdegiknostuz", "o": "bcdfgilmnoprstuvw",
    "p": "aefhiloprstu", "q": "u", "r": "acdegikmnorstuvy", "s": "acehikloptsuz", "t": "aehilorstuyz", "u": "abcdefgilmnprst", "v": "aeio", "w": "aehinor",
    "x": "aept", "y": "aeos", "z": "aeituwy",
}


def odd_pair(a: str, b: str) -> bool:
    """Whether neighbours are unlike words: a letter by a digit, a capital after a small letter, or letters that rarely follow."""
    if a.isalpha() and b.isalpha():
        return (a.islower() and b.isupper()) or b.lower() not in _FOLLOW[a.lower()]
    return (a.isalpha() and b.isdigit()) or (a.isdigit() and b.isalpha())


def odd_windows(run: str, rule: EntropyRule) -> Iterator[tuple[int, int]]:
    """(start, end) of the windows of ``run`` that are random by their pairs; the count of odd pairs is kept up to date."""
    w = rule.window
    odd = [odd_pair(a, b) for a, b in zip(run, run[1:], strict=False)]
    n = sum(odd[: w - 1])
    for i in range(len(run) - w + 1):
        if i:
            n += odd[i + w - 2] - odd[i - 1]
        if n >= rule.odd_pairs and math.log2(w) - sum(c * math.log2(c) for c in Counter(run[i : i + w]).values()) / w >= rule.random_bits:
            yield i, i + w


def merged(spans: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans that touch as one."""
    start = end = None
    for a, b in sorted(spans):
        if start is not None and a <= end:
            end = max(end, b)
        else:
            if start is not None:
                yield start, end
            start, end = a, b
    if start is not None:
        yield start, end


def uncovered(start: int, end: int, known: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What the disjoint spans of ``known``, in order, leave of a span; found by bisection, not by looking at all."""
    for k in range(bisect_right(known, start, key=lambda x: x[1]), len(known)):
        s, e = known[k]
        if s >= end:
            break
        if s > start:
            yield start, s
        start = max(start, e)
    if start < end:
        yield start, end


class Scanner:
    """Finds the spans of one text after another."""

    def __init__(self, rule: EntropyRule = EntropyRule()):
        self.rule = rule
        self.run = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{rule.min_run},}}")
        self.allow = re.compile("|".join(f"(?:{a})" for a in rule.allow)) if rule.allow else None

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, kind, end) in order of start, then kind."""
        if not text:
            return []
        out = []
        low = text.lower()
        if "passw" in low or "secret" in low or "token" in low or "api" in low:
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        known = list(merged((s, e) for s, _, e in out))
        for m in self.run.finditer(text):
            if self.allow and self.allow.fullmatch(m[0]):
                continue
            for a, b in merged([*hot_windows(m[0], self.rule), *odd_windows(m[0], self.rule)]):
                rest = uncovered(a + m.start(), b + m.start(), known)
                out += [(x, 3, y) for x, y in rest if any(c.isalnum() for c in text[x:y])]  # marks alone are no secret
        return sorted(out)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(documents: DataFrame, rule: EntropyRule = EntropyRule()) -> DataFrame:
    """Per document: doc_id, counts and digest of the base spans, and all spans as text. One pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(rule)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                spans = scanner.spans(text)
                n = [0, 0, 0, 0]
                for _, k, _ in spans:
                    n[k] += 1
                base = _joined(x for x in spans if x[1] < 3)
                rows.append((doc_id, n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), _joined(spans), n[3]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])

    return with_null_id(with_id(documents).mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"))


def redact(text: str | None, scanner: Scanner | None = None, mark: str = "[SECRET]") -> str | None:
    """The text with every span replaced by ``mark``; overlapping spans become one. Null stays null."""
    if text is None:
        return None
    out, at = [], 0
    for s, _, e in (scanner or Scanner()).spans(text):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))
