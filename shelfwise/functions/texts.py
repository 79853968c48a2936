"""Strict reading of JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import let

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def strict_json(text: Column) -> Column:
    """The variant of a text that is one JSON document and nothing else; null for any other text.

    Spark's parsers stop at the end of the first document. As an element of an array that goes on behind it,
    the text has to end there too: what trails it breaks the array or adds elements.
    """
    framed = F.concat(F.lit("["), text, F.lit(",0]"))
    return let(
        F.from_json(framed, "array<variant>", _STRICT), lambda both: F.when(F.size(both) == 2, F.get(both, F.lit(0)))
    )
