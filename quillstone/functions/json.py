"""JSON held in text columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys whose values are never kept (fixed values), the deepest level, the longest list and the longest text that are.
SECRET, DEPTH, ITEMS, CHARACTERS = r"password|secret|token|api_?key|authorization|cookie|credential", 6, 200, 8000
HIDDEN, DEEP = "[redacted]", "[deep]"


def embedded(text: Column) -> Column:
    """The JSON object inside a text, from its first brace to its last; null if that doesn't parse."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), found)


def redacted(text: Column, secret: str = SECRET, depth: int = DEPTH, items: int = ITEMS, characters: int = CHARACTERS) -> Column:
    """A JSON text without secrets and of a bounded size, keys sorted; what isn't JSON becomes null.

    A list beyond ``items`` ends with a mark that says how many elements are missing, a text beyond ``characters`` with one that
    says how many characters are; what lies deeper than ``depth`` is replaced by a mark.
    """
    hide = re.compile(secret, re.I).search

    def cut(value: object) -> object:
        """What stands in for a value; containers stay and come to their own turn, lists cut."""
        if isinstance(value, str) and len(value) > characters:
            return f"{value[:characters]}[{len(value) - characters} more characters]"
        return [*value[:items], f"[{len(value) - items} more]"] if isinstance(value, list) and len(value) > items else value

    def bounded(document: object) -> object:
        whole = [cut(document)]
        level: list = [whole]  # the containers of one depth
        for _ in range(depth + 2):
            below = []
            for box in level:
                for place in list(box) if isinstance(box, dict) else range(len(box)):
                    box[place] = HIDDEN if isinstance(box, dict) and hide(place) else cut(box[place])
                    if isinstance(box[place], dict | list):
                        below.append((box, place))
            level = [box[place] for box, place in below]
        for box, place in below:  # those that were never entered
            box[place] = DEEP
        return whole[0]

    @F.pandas_udf(T.StringType())
    def run(column: pd.Series) -> pd.Series:
        def one(t: str) -> str | None:
            try:
                return json.dumps(bounded(json.loads(t)), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        return column.map(one, na_action="ignore")

    return run(text)


def _merge(a: object, b: object) -> object:
    if isinstance(a, dict) and isinstance(b, dict):
        return {**a, **{k: _merge(a[k], v) if k in a else v for k, v in b.items()}}
    return b


@F.pandas_udf(T.StringType())
def merged(left: pd.Series, right: pd.Series) -> pd.Series:
    """Two JSON objects merged at every depth; on scalars and lists the right one wins; a null side leaves the other."""

    def one(a: str | None, b: str | None) -> str | None:
        if a is None or b is None:
            return b if a is None else a
        return json.dumps(_merge(json.loads(a), json.loads(b)), sort_keys=True, ensure_ascii=False, separators=(",", ":"))

    return pd.Series([one(a, b) for a, b in zip(left, right)], dtype=object)
