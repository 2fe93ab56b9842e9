"""Token estimates of a line, and of all lines of a file inside its row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafledger.functions.lookups import TOKEN_FAMILIES, one_of
from leafledger.functions.text import count_of, split_lines

# Weights; the symbols counted in code and the separators of data
# are listed in the classes below.
CODE_WORD, CODE_SYMBOL, DATA_WORD, TEXT_WORD = 1.3, 0.5, 1.1, 1.3

WORD = "w"
# ``(?U)`` makes ``\s`` the Unicode White_Space property; Java matches it several
# times faster than the same characters spelled out.
_WORDS = "(?U)\\S++"
_DATA_WORDS = "(?U)[^\\s{}\\[\\]\",:]++"
_TEXT_WORDS = "(?U)[^\\s\\p{P}]++"
_NOT_SYMBOLS = "[^\\n{}()\\[\\];,.:+\\-*/=<>!&|%^~]++"

# What a code file loses before counting: the rest of a line from the first
# ``//`` or ``#`` and, in the code family, lines that begin with ``/*``.
_COMMENT = "(?://|#)[^\\n]*+"
_COMMENT_OR_BLOCK = "(?dmU)(?:^[\\s&&[^\\n]]*+/\\*|//|#)[^\\n]*+"


def _mark(text: Column, words: str) -> Column:
    """Each word reduced to one letter; what lies between words, newlines too, stays."""
    return F.regexp_replace(text, words, WORD)


def _count(marked: Column) -> Column:
    return count_of(marked, WORD)


def _weigh(words: Column, weight: float) -> Column:
    return (words * F.lit(weight)).cast("long")


def _weigh_code(words: Column, symbols: Column) -> Column:
    return (words * F.lit(CODE_WORD) + symbols * F.lit(CODE_SYMBOL)).cast("long")


def code_tokens(line: Column) -> Column:
    """Words and symbols before the first ``//`` or ``#``."""
    code = F.regexp_replace(line, _COMMENT, "")
    symbols = F.octet_length(F.regexp_replace(code, _NOT_SYMBOLS, ""))
    return _weigh_code(_count(_mark(code, _WORDS)), symbols)


def data_tokens(line: Column) -> Column:
    """Words once brackets, quotes, commas and colons are taken as blanks."""
    return _weigh(_count(_mark(line, _DATA_WORDS)), DATA_WORD)


def text_tokens(line: Column) -> Column:
    """Words between white space and punctuation."""
    return _weigh(_count(_mark(line, _TEXT_WORDS)), TEXT_WORD)


def default_tokens(line: Column) -> Column:
    return F.shiftright(F.octet_length(line), 2).cast("long")


def _total(per_line: Column) -> Column:
    return F.aggregate(per_line, F.lit(0).cast("long"), lambda acc, n: acc + n)


def _by_line(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _code_total(text: Column, comment: str) -> Column:
    code = F.regexp_replace(text, comment, "")
    words = _by_line(_mark(code, _WORDS))
    symbols = _by_line(F.regexp_replace(code, _NOT_SYMBOLS, ""))
    return _total(
        F.zip_with(words, symbols, lambda w, s: _weigh_code(_count(w), F.octet_length(s)))
    )


def _word_total(text: Column, words: str, weight: float) -> Column:
    return _total(F.transform(_by_line(_mark(text, words)), lambda w: _weigh(_count(w), weight)))


def family_total(family: str, text: Column) -> Column:
    """Tokens of a whole text.

    The expensive patterns run once over the text, not once per line; what they
    leave is one letter per word, cut at newlines, since each line is rounded
    down by itself.  A line without words adds nothing, so blank lines and
    comment lines need no test.
    """
    if family == "code":
        return _code_total(text, _COMMENT_OR_BLOCK)
    if family == "script":
        return _code_total(text, _COMMENT)
    if family == "data":
        return _word_total(text, _DATA_WORDS, DATA_WORD)
    if family == "text":
        return _word_total(text, _TEXT_WORDS, TEXT_WORD)
    return _total(F.transform(split_lines(text), default_tokens))


def file_tokens(ext_key: Column, text: Column) -> Column:
    """Tokens of a file by its extension's family."""
    counted = family_total("other", text)
    for family, extensions in TOKEN_FAMILIES.items():
        counted = F.when(one_of(ext_key, extensions), family_total(family, text)).otherwise(counted)
    return counted.cast("long")


def rough_tokens(size_bytes: Column) -> Column:
    """One token per four bytes."""
    return F.shiftright(size_bytes.cast("long"), 2)
