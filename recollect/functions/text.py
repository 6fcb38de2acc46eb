"""Text transforms as column expressions."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9][A-Za-z0-9_.-]*"
#: `\\b` with ASCII word characters, whatever the regex engine takes for a word.
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


#: What a full-text index takes for a token: letters and digits of any script, with marks on them.
INDEXED = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{Mn}]*"


@functools.cache
def _plain_letters() -> tuple[str, str]:
    """Letters with marks and, in the same places, what they are without; then the marks alone, which go."""
    pairs = []
    for c in map(chr, range(0x80, 0x3000)):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != c:
            pairs.append((c, base))
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


def plain_letters(token: Column) -> Column:
    """A token without diacritics; most have none, which their length in bytes tells."""
    return F.when(F.octet_length(token) == F.length(token), token).otherwise(F.translate(token, *_plain_letters()))


def index_tokens(text: Column) -> Column:
    """A text's index tokens in order, in lower case, with their diacritics."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({INDEXED})"), 1)


def phrases(query: Column) -> Column:
    """What a query asks for: each of its tokens as the phrase of index tokens that it consists of, joined by spaces."""
    return F.transform(tokens(query), lambda t: F.array_join(F.regexp_extract_all(t, F.lit("([a-z0-9]+)"), 1), " "))


def tokens(text: Column, lower: bool = True) -> Column:
    """ASCII tokens in order, with repeats, lower-cased unless that is done later."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), 1)
    return F.transform(found, F.lower) if lower else found


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def normalised(text: Column) -> Column:
    return F.lower(F.trim(text))


def label_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def folded(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[\s\-_.]+", "")


#: Suffixes of repositories, on the folded name.
REPO_SUFFIXES = ("ts", "js", "py", "rs", "go")


def repo_base(fold: Column) -> Column:
    return F.when(F.length(fold) > 2, F.regexp_replace(fold, f"({'|'.join(REPO_SUFFIXES)})$", "")).otherwise(fold)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)/*$", 1)


def chunks(header: Column, body: Column, size: int = 5500, overlap: int = 500) -> Column:
    """An array of pieces: the header with as much body as fits, then windows of `size` that overlap; each trimmed."""
    head, text = F.trim(F.coalesce(header, F.lit(""))), F.trim(F.coalesce(body, F.lit("")))
    prefix = F.when(head != "", F.concat(head, F.lit(" "))).otherwise("")
    budget = F.greatest(F.lit(1), size - F.length(prefix))
    first = F.trim(F.concat(prefix, F.substring(text, F.lit(1), budget)))
    start = F.greatest(F.lit(0), budget - overlap)
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - start - size) / step)).cast("int")
    rest = F.transform(F.sequence(F.lit(0), last), lambda k: F.trim(F.substring(text, start + k * step + 1, F.lit(size))))
    rest = F.filter(rest, lambda x: x != "")
    return (
        F.when((head == "") & (text == ""), F.array().cast("array<string>")).when(text == "", F.array(head))
        .when(F.length(text) <= budget, F.array(first)).otherwise(F.concat(F.array(first), rest))
    )


def short_id(*parts: Column) -> Column:
    """The first 16 digits of SHA-256 over the parts, joined by `|`; nulls count as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 16)


def snippet(text: Column, first: Column, around: int = 60) -> Column:
    """The text around the place `first` (from 1; 0: not found), with marks where it was cut."""
    begin = F.greatest(F.lit(1), first - around)
    cut = F.substring(text, begin, F.lit(2 * around))
    out = F.concat(F.when(begin > 1, "...").otherwise(""), cut, F.when(begin + 2 * around <= F.length(text), "...").otherwise(""))
    return F.when(first > 0, out).otherwise(F.substring(text, 1, 2 * around))
