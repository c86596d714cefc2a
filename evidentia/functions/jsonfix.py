"""JSON out of model answers: the first object in a text, parsed with growing tolerance."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def first_object(text: str | None) -> str | None:
    """The first balanced {...}; braces in strings don't count. Null if none closes."""
    depth, start, quoted, escaped = 0, None, False, False
    for i, c in enumerate(text or ""):
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            start, depth = (i if depth == 0 else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                return text[start : i + 1]
    return None


def parse(text: str | None):
    """As JSON, with control characters dropped, with stray backslashes doubled, as a Python literal; else an empty object."""
    body = first_object(text) or (text or "")
    fixed = _CONTROL.sub("", body)
    for attempt in (body, fixed, re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", fixed)):
        try:
            return json.loads(attempt)
        except ValueError:
            pass
    try:
        value = ast.literal_eval(fixed)
        return value if isinstance(value, dict | list) else {}
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return {}


@F.pandas_udf(T.StringType())
def repaired_json(texts: pd.Series) -> pd.Series:
    """Canonical JSON of each text's first object."""
    return texts.map(lambda t: json.dumps(parse(t), sort_keys=True, ensure_ascii=False))
