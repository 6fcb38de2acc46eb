"""Removal of context blocks that were injected into a text: from a header line up to its footer line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOOTER = "Tools:"


def strip_blocks(text: Column, headers: list[str], footer: str = FOOTER) -> Column:
    """Header..footer blocks go, runs of blank lines become one, blank ends go. Texts without a footer stay as they are."""
    head = "|".join(rf"\Q{h}\E" for h in headers)
    out = F.regexp_replace(text, rf"(?ms)^[ \t]*(?:{head})[ \t]*$.*?^\Q{footer}\E[^\n]*\n?", "")
    out = F.regexp_replace(out, r"\n(?:[ \t]*\n){2,}", "\n\n")
    out = F.regexp_replace(F.regexp_replace(out, r"^(?:[ \t]*\n)+", ""), r"(?:\n[ \t]*)+\z", "")
    return F.when(F.contains(text, F.lit(footer)), out).otherwise(text)
