"""Text expressions: white space, query and index tokens, accents, prefix queries."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an index token is: letters, digits, private-use characters and the underscore; marks may follow.
INDEX_TOKEN = r"[\p{L}\p{N}\p{Co}_][\p{L}\p{N}\p{Co}\p{Mn}_]*"
QUERY_TOKEN = r"[A-Za-z0-9_]+"
MIN_QUERY_TOKEN = 3
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _folds() -> tuple[str, str]:
    """Lower-case Latin letters with one accent and the letters without it; the final sigma and sigma."""
    pairs = [("ς", "σ")]
    for i in range(0x80, min(0x2000, sys.maxunicode)):
        c = unicodedata.normalize("NFD", chr(i))
        if len(c) == 2 and unicodedata.combining(c[1]) and c[0].isascii() and c[0].isalpha() and chr(i) == chr(i).lower():
            pairs.append((chr(i), c[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folds()


def trim_ws(text: Column) -> Column:
    """Without leading and trailing Unicode white space, the separators U+001C to U+001F included."""
    return F.btrim(text, F.lit(WHITE))


def rtrim_ws(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def _is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def _plain(token: Column) -> Column:
    """Lower case, single accents of Latin letters removed."""
    low = F.lower(token)
    return F.when(_is_ascii(token), low).otherwise(F.translate(low, ACCENTED, PLAIN))


def _bare(token: Column) -> Column:
    """Without marks, which few tokens have after ``_plain``."""
    return F.when(_is_ascii(token), token).otherwise(F.regexp_replace(token, r"\p{Mn}", ""))


def fold(token: Column) -> Column:
    """Lower case, accents and marks removed."""
    return _bare(_plain(token))


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(INDEX_TOKEN), F.lit(0))


def index_tokens(text: Column) -> Column:
    """Tokens as they stand in an unstemmed index, in order, repeats kept."""
    return F.transform(F.transform(raw_tokens(text), _plain), _bare)


def query_tokens(text: Column) -> Column:
    """ASCII tokens of three characters or more, in order; repeats are kept, since each one scores."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(QUERY_TOKEN), F.lit(0))
    return F.filter(tokens, lambda t: F.length(t) >= MIN_QUERY_TOKEN)


def match_query(text: Column) -> Column:
    """The prefix query as text: ``one* OR two*``; empty if no token is usable."""
    return F.array_join(F.transform(query_tokens(text), lambda t: F.concat(t, F.lit("*"))), " OR ")


def match_start(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern that has to match at the start; null if it doesn't."""
    anchored = f"(?U)^(?:{pattern})"
    return F.when(text.rlike(anchored), F.regexp_extract(text, anchored, group))


def joined(ordered: Column, by: str = "\n") -> Column:
    """Texts of an array of (order, text) in order, joined."""
    return F.array_join(F.transform(F.array_sort(ordered), lambda x: x["text"]), by)
