"""Tokenisers as native column expressions.

Two analysers exist.  ``space`` cuts on Unicode white space and punctuation;
``zh`` does the same and also makes every Han character a token of its own.
``none`` yields no tokens: such a field can only be filtered.

Rules shared by both analysers:

* ``.``, ``-`` and ``:`` may sit inside a token but not at its ends;
* text between a pair of equal quotes (``'``, ``"`` or `````) is one token, its
  spaces included; a quote without a twin merely separates;
* nothing is lower-cased, stemmed or stopped.

The whole analysis is one ``regexp_extract_all`` over the row's text, so it stays
inside the JVM and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The analyser names, the characters allowed inside a token, the
# quote characters, and the white-space class (Unicode White_Space).
SPACE = "space"
HAN = "zh"
NONE = "none"
TOKENIZERS = (HAN, SPACE, NONE)
INNER = r".\-:"
QUOTES = "'\"`"
WHITE = r"\t\n\x0B\f\r \x{85}\x{A0}\p{Z}"

_QUOTED = r"""'[^']*'|"[^"]*"|`[^`]*`"""
_WORD_CHAR = rf"[^{WHITE}\p{{P}}{QUOTES}]"
_WORD_CHAR_NO_HAN = rf"[^{WHITE}\p{{P}}{QUOTES}\p{{IsHan}}]"


def _word(ch: str) -> str:
    # First and last character are word characters, so the ends come out trimmed.
    # The middle is a single character class: a repeated group would recurse once
    # per character in the regex engine and overflow on very long runs.
    return rf"{ch}(?:[{INNER}{ch}]*{ch})?"


PATTERNS = {
    SPACE: rf"{_QUOTED}|{_word(_WORD_CHAR)}",
    HAN: rf"{_QUOTED}|\p{{IsHan}}|{_word(_WORD_CHAR_NO_HAN)}",
}
_STRIP_QUOTED = rf"\A[{QUOTES}][{INNER}]*|[{INNER}]*[{QUOTES}]\z"
_ANY_QUOTE = rf"[{QUOTES}]"
_EDGE_SPACE = rf"\A[{WHITE}]+|[{WHITE}]+\z"


def no_tokens() -> Column:
    return F.array().cast("array<string>")


def tokens(text: Column, tokenizer: str = SPACE) -> Column:
    """Ordered tokens of ``text``; an empty array for NULL, ``""`` or ``none``."""
    if tokenizer == NONE:
        return no_tokens()
    found = F.regexp_extract_all(text, F.lit(PATTERNS[tokenizer]), F.lit(0))
    # Only texts holding a quote pay for the second pass over their tokens.
    unquoted = F.filter(
        F.transform(
            found,
            lambda t: F.when(
                F.substring(t, 1, 1).isin(*QUOTES), F.regexp_replace(t, _STRIP_QUOTED, "")
            ).otherwise(t),
        ),
        lambda t: t != "",
    )
    return F.coalesce(F.when(text.rlike(_ANY_QUOTE), unquoted).otherwise(found), no_tokens())


def token_count(text: Column, tokenizer: str = SPACE) -> Column:
    """``size(tokens(text, tokenizer))``; only texts with a quote build their tokens for it."""
    if tokenizer == NONE:
        return F.lit(0)
    plain = F.coalesce(F.regexp_count(text, F.lit(PATTERNS[tokenizer])), F.lit(0))
    return F.when(text.rlike(_ANY_QUOTE), F.size(tokens(text, tokenizer))).otherwise(plain)


def has_token(text: Column, token: Column, tokenizer: str = SPACE) -> Column:
    """Whether one of the tokens of ``text`` equals ``token``.

    A token is a contiguous piece of its text, so the substring test in front is
    exact and spares tokenising rows that cannot match.
    """
    return F.contains(text, token) & F.array_contains(tokens(text, tokenizer), token)


def trim_space(text: Column) -> Column:
    """Strip Unicode white space at both ends (``trim`` knows only U+0020)."""
    return F.regexp_replace(text, _EDGE_SPACE, "")
