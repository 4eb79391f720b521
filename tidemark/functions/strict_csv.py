"""RFC 4180 on the JVM: well-formed quoting and the number of fields, without walking the characters in Python.

Splitting a line at its quotes leaves the text outside quotes at the even places.  Quoting is well formed if the number
of quotes is even and every outer piece is empty (a doubled quote inside a field, or the edge of the line) or touches
its neighbouring quotes with a comma.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPTIONS = {"sep": ",", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1", "emptyValue": "", "nullValue": "", "lineSep": "\n"}


def pieces(line: Column) -> Column:
    return F.split(line, '"', -1)


def outer(parts: Column) -> Column:
    """The pieces outside quotes."""
    return F.filter(parts, lambda _, i: i % 2 == 0)


def well_formed(line: Column) -> Column:
    """Quotes only around whole fields, doubled inside, no bare line break.  A null line is not well formed.

    The lambdas look at nothing but their own piece, so the work grows with the length of the line.
    """
    parts = pieces(line)

    def fits(p: Column, i: Column) -> Column:
        return (i % 2 == 1) | (i == 0) | (p == "") | (p.startswith(",") & p.endswith(","))

    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    ends = ((first == "") | first.endswith(",")) & ((last == "") | last.startswith(","))
    inner = F.forall(F.slice(F.transform(parts, fits), F.lit(1), F.size(parts) - 1), lambda ok: ok)
    no_break = ~F.exists(outer(parts), lambda p: p.rlike(r"[\r\n]"))
    sound = no_break & (F.size(parts) % 2 == 1) & ((F.size(parts) == 1) | (ends & inner))
    return F.coalesce(sound, F.lit(False))


def field_count(line: Column) -> Column:
    """Fields of a well-formed line: one more than the commas outside quotes.  The empty line has one field."""
    return F.aggregate(outer(pieces(line)), F.lit(1), lambda n, p: n + F.length(p) - F.length(F.replace(p, F.lit(","))))


def fields(line: Column, names: list[str]) -> Column:
    """Struct of the fields of a well-formed line with as many fields as names."""
    return F.from_csv(line, ", ".join(f"`{n}` string" for n in names), OPTIONS)
