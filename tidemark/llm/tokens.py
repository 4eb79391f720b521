"""Token counts of a text on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The blocks whose characters are a token each, and the white space of the word split.
SINGLE = r"　-〿぀-ヿ一-鿿＀-￯!-/:-@\[-`{-~"
SPACE = r"\p{Z}\s\u0085\x1c-\x1f"
TOKEN = rf"[{SINGLE}]|[^{SINGLE}{SPACE}]+"


def token_count(text: Column) -> Column:
    """Tokens of the basic word split; 0 for an empty or null text.

    One per wide or ASCII punctuation character, and one per longest run of other characters without white space: the
    single characters are counted by what their removal takes away, the runs by the places where a run begins.
    """
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(TOKEN)).cast("long")
