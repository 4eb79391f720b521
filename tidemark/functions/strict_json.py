"""Strict JSON on the JVM.

Spark's parser stops at the end of the first value and never looks at what follows it.  Two parses of the line inside
a wrapper close the gap.  In ``{"r":LINE}`` the line may be followed only by `}` or `,"key":`; in ``{"r":[LINE]}``
only by `]` or `,value` with no colon.  A line that passes both is therefore exactly one value: after its first value
the two wrappers allow nothing in common but the end.  All extensions of the parser are off, so what is left is RFC 8259.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"
OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT,
    "allowComments": "false",
    "allowUnquotedFieldNames": "false",
    "allowSingleQuotes": "false",
    "allowNumericLeadingZeros": "false",
    "allowNonNumericNumbers": "false",
    "allowBackslashEscapingAnyCharacter": "false",
    "allowUnquotedControlChars": "false",
    "maxNestingDepth": "1000000",
    "maxNumLen": "100000000",
    "maxStringLen": "2000000000",
}


def parse_object(text: Column, schema: str) -> Column:
    """Struct(r, _corrupt_record): r is the typed object, _corrupt_record is set if a field has another type than in
    ``schema`` or the JSON is broken.  Says nothing about text after the object: see ``is_one_value``."""
    return F.from_json(F.concat(F.lit('{"r":'), text, F.lit("}")), f"r struct<{schema}>, {CORRUPT} string", OPTIONS)


def is_one_value(text: Column) -> Column:
    """Second half of the check: with ``parse_object`` free of errors, the text is exactly one JSON value."""
    return F.from_json(F.concat(F.lit('{"r":['), text, F.lit("]}")), f"z string, {CORRUPT} string", OPTIONS)[CORRUPT].isNull()


def parse_start(text: Column, schema: str) -> Column:
    """The object a text begins with, as fields of ``schema`` and _corrupt_record; what follows it is not looked at."""
    return F.from_json(text, f"{schema}, {CORRUPT} string", OPTIONS)
