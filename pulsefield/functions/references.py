"""References in JSON selections."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsefield.functions.text import NULL_WORDS

#: Words of selections that name nothing.
IGNORED = ("false", "true", "null", "none", "video", "videos", "cluster", "clusters", "selected", "items", "en", "hi")


def leaves(node: object) -> Iterator[str]:
    """The keys and values of a parsed document in its order."""
    if isinstance(node, dict):
        for key, child in node.items():
            yield key
            yield from leaves(child)
    elif isinstance(node, list):
        for child in node:
            yield from leaves(child)
    elif node is not None:
        yield str(node)


def json_references(c: Column) -> Column:
    """Keys and values of at least four letters of a JSON text that aren't ignored words, once each in order; of other texts the text."""

    @F.pandas_udf("array<string>")
    def walk(texts: pd.Series) -> pd.Series:
        def of(text: str | None) -> list[str]:
            if text is None or text.strip().lower() in NULL_WORDS:
                return []
            try:
                parsed = json.loads(text)
            except ValueError:
                parsed = text
            found = (x.strip() for x in leaves(parsed))
            return list(dict.fromkeys(x for x in found if len(x) >= 4 and x.lower() not in IGNORED and x.lower() not in NULL_WORDS))

        return texts.map(of)

    return walk(c.cast("string"))
