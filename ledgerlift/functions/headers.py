"""Expressions that read and normalise column headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_EDGE_SPACE = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$"


def strip_space(text: Column) -> Column:
    """Remove Unicode white space at both ends; ``trim`` only knows the plain blank."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def normalize_header(header: Column) -> Column:
    """Letters and digits only, ASCII letters in lower case."""
    kept = F.regexp_replace(header, r"[^\p{IsAlphabetic}\p{N}]", "")
    return F.translate(kept, _UPPER, _UPPER.lower())


def clean_header(name: Column) -> Column:
    """One header cell without surrounding space and quotes."""
    return F.regexp_replace(strip_space(name), r'^"+|"+$', "")


def header_names(text: Column) -> Column:
    """Array of header names in the first line of ``text``: no BOM, no empty names.

    Quoted commas split a name, as in the format being matched.
    """
    no_bom = F.regexp_replace(text, r"^\uFEFF", "")
    first_line = F.regexp_replace(F.substring_index(no_bom, "\n", 1), "\r$", "")
    names = F.transform(F.split(first_line, ","), clean_header)
    return F.filter(names, lambda n: n != "")
