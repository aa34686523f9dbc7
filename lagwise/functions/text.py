"""Text cleaning, counting, tokenising and n-grams over whole texts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: patterns that define what a token is ---------------------------------
WRITTEN_ESCAPE = r"\\[tnr]"
UNWANTED = r"[^A-Za-z0-9']+"
RICH_TOKEN = r"\b[A-Za-z0-9()'\-?!\"%]+\b"
LETTER_TOKEN = r"[a-zA-Z]+"
# ----------------------------------------------------------------------------------------


def _accent_pairs() -> tuple[str, str]:
    """Latin letters whose compatibility decomposition is one ASCII letter plus marks.

    Covered alphabet: Latin-1 Supplement, Latin Extended-A and -B, Latin Extended Additional.
    Free-standing combining marks (U+0300..U+036F) are removed.
    """
    source, target = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFKD", chr(code))
        base = "".join(ch for ch in parts if not unicodedata.combining(ch))
        if parts != chr(code) and len(base) == 1 and base.isascii():
            source.append(chr(code))
            target.append(base)
    marks = [chr(code) for code in range(0x0300, 0x0370)]
    return "".join(source + marks), "".join(target)


_ACCENTED, _PLAIN = _accent_pairs()


def strip_nul(text: Column) -> Column:
    """Drop NUL characters and turn CR LF and CR into LF."""
    return F.regexp_replace(F.translate(text, "\u0000", ""), "\r\n?", "\n")


def clean_text(text: Column, lower: bool = False) -> Column:
    """Keep letters, digits and apostrophes; any run of the rest becomes one space.

    Written-out escapes (backslash followed by t, n or r) count as unwanted. NULL gives ''.
    """
    unescaped = F.regexp_replace(F.coalesce(text, F.lit("")), WRITTEN_ESCAPE, " ")
    cleaned = F.trim(F.regexp_replace(unescaped, UNWANTED, " "))
    return F.lower(cleaned) if lower else cleaned


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; NULL and '' give 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def fold_accents(text: Column) -> Column:
    return F.translate(text, _ACCENTED, _PLAIN)


def rich_tokens(text: Column) -> Column:
    """Lower-cased tokens that may hold digits, apostrophes and some punctuation."""
    return F.regexp_extract_all(F.lower(text), F.lit(RICH_TOKEN), F.lit(0))


def letter_tokens(text: Column) -> Column:
    """Lower-cased, accent-folded runs of letters."""
    return F.regexp_extract_all(F.lower(fold_accents(text)), F.lit(LETTER_TOKEN), F.lit(0))


def ngrams_of_size(tokens: Column, n: int) -> Column:
    """All runs of ``n`` consecutive tokens joined by a space."""
    if n == 1:
        return tokens
    starts = F.sequence(F.lit(0), F.size(tokens) - F.lit(n))
    runs = F.transform(
        starts,
        lambda i: F.concat(F.get(tokens, i), *[part for k in range(1, n) for part in (F.lit(" "), F.get(tokens, i + k))]),
    )
    return F.when(F.size(tokens) >= n, runs).otherwise(F.array().cast("array<string>"))


def ngrams(tokens: Column, largest: int) -> Column:
    """N-grams of size 1..largest in one array.

    The tokens are bound to a lambda variable, so the tokenizer runs once per text and not
    once per n-gram.
    """
    if largest == 1:
        return tokens
    bound = F.transform(
        F.array(tokens),
        lambda t: F.concat(*[ngrams_of_size(t, n) for n in range(1, largest + 1)]),
    )
    return F.element_at(bound, 1)
