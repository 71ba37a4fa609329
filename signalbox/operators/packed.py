"""Several values packed in one field (problem 3).

``split_packed`` turns a string column into one row per value with its position. Everything is a
Catalyst expression: no Python worker, no shuffle, one pass over the scan.

Defined results
---------------
* null, empty, blank and delimiter-only fields give no rows;
* empty pieces, including an empty pair of quotes, give no value and take no position;
* repeats and letter case are kept; order is the order of the field;
* an opening quote without its closing partner is ordinary text;
* extra columns pass through untouched, and may have any names: the working columns are dropped and
  the two result names are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks that always separate, and those that separate unless they belong to a number, size or code.
HARD = ";|•、，\t\n\r；"
_ANY = HARD + ",/·"
#: Quotes that may enclose a value: (opening, closing).
QUOTES = (('"', '"'), ("'", "'"), ("“", "”"), ("«", "»"), ("„", "“"), ("‹", "›"))

# Marks that stand for an enclosing quote and for a comma that separates nothing. They begin with a sign that is doubled
# where the text itself holds it, so no text can be taken for a mark and none is lost.
_SIGN = "\ue000"
_ITSELF, _QUOTE, _COMMA = _SIGN + "\ue001", _SIGN + "\ue002", _SIGN + "\ue003"

_GAP = r"[^\S\t\n\r]*+"  # space that is no separator itself
_START = rf"(?<=^|[{_ANY}]){_GAP}"


def _enclosed() -> str:
    """A regex for one enclosed value: it opens at the start of a piece and closes at its end. Its groups are, for each
    kind of quotes, the opening one and what is inside."""
    ends = rf"(?:\s*+$|{_GAP}[{_ANY}])"
    forms = []
    for a, b in QUOTES:
        if a == b:
            inner = rf"[^{a}]*+(?:(?:{a}{a}|{a}(?!{ends}))[^{a}]*+)*+"
        else:
            inner = rf"[^{b}]*+(?:{b}(?!{ends})[^{b}]*+)*+"
        forms.append(rf"({a})({inner}){b}(?={ends})")
    return f"{_START}(?:{'|'.join(forms)})"


#: A comma is part of a number when digits stand on both sides and the digits before it begin the piece.
_DECIMAL = rf"({_START}\d++),(?=\d)"
#: A slash or middle dot separates only with space, an edge or another mark beside it.
_SEPARATOR = rf"[{HARD},]|(?:(?<=^|\s|[{_ANY}])[/·]|[/·](?=\s|$|[{_ANY}]))"


def pieces(text: Column) -> Column:
    """The values of one packed field, as an array in the field's order."""
    marked = F.replace(text, F.lit(_SIGN), F.lit(_ITSELF))
    groups = "".join(f"${i + 1}" for i in range(2 * len(QUOTES)))  # those of other kinds are empty
    marked = F.regexp_replace(marked, _enclosed(), f"{_QUOTE}{groups}{_QUOTE}")
    runs = F.split(marked, _QUOTE)

    def literal(run: Column) -> Column:
        """What an odd run holds after its quote; of straight quotes, the enclosing one doubled stands for one."""
        quote, rest = F.substring(run, 1, 1), F.substring(run, F.lit(2), F.length(run))
        return F.when(quote == '"', F.replace(rest, F.lit('""'), F.lit('"'))).when(quote == "'", F.replace(rest, F.lit("''"), F.lit("'"))).otherwise(rest)

    divided = lambda run: F.transform(F.split(F.regexp_replace(run, _DECIMAL, f"$1{_COMMA}"), _SEPARATOR), lambda v: F.replace(v, F.lit(_COMMA), F.lit(",")))
    values = F.flatten(F.transform(runs, lambda run, i: F.when(i % 2 == 1, F.array(literal(run))).otherwise(divided(run))))
    trimmed = F.transform(values, lambda v: F.replace(F.regexp_replace(v, r"(?U)^\s++|(?<!\s)\s++$", ""), F.lit(_ITSELF), F.lit(_SIGN)))
    return F.filter(trimmed, lambda v: v != "")


def split_packed(df: DataFrame, column: str, value: str = "value", pos: str = "pos") -> DataFrame:
    """One row per value of ``df[column]`` with its position from 1, beside all columns of ``df``.

    A column of ``df`` that already bears a result's name is left out in its favour.
    """
    kept = [c for c in df.columns if c not in (value, pos)]
    arrayed = df.select(*[F.col(f"`{c}`") for c in kept], pieces(F.col(f"`{column}`")).alias("__values"))
    return arrayed.select(
        *[F.col(f"`{c}`") for c in kept], F.posexplode("__values").alias("__pos", "__value")
    ).select(*[F.col(f"`{c}`") for c in kept], (F.col("__pos") + 1).alias(pos), F.col("__value").alias(value))
