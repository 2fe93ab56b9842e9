"""Line classification without a row per line.

A file's lines are turned into a string with one letter per line.  Whether a
line lies inside a block comment depends on the lines before it; on the string
of letters that is one regular-expression replacement, so files are never
exploded or shuffled to be classified.

Letters of a line that is not inside a block:

====== ===================================================
``b``  blank
``s``  holds a block start and no block end: opens a block
``w``  holds both a start and an end: comment of one line
``/``  line comment            (``p`` if it holds an end)
``0``  code                    (``q``)
``1``  code, function head     (``r``)
``2``  code, control line      (``t``)
``3``  code, both              (``u``)
====== ===================================================

Lines found inside a block become ``i``; blank lines stay blank.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafledger.functions.lookups import COMMENT_SYNTAX, one_of
from leafledger.functions.text import split_lines, strip

# What makes a code line complex, and by how much.
_BLANK = "[\\t\\n\\f\\r ]"
CONTROL_LINE = f"{_BLANK}+(if|for|while|switch){_BLANK}+[^\\n]*\\{{"
FUNCTION_HEAD = f"{_BLANK}*func{_BLANK}+[0-9A-Za-z_]+{_BLANK}*\\("
CONTROL_SCORE, FUNCTION_SCORE = 1.0, 0.5

COMMENT, CODE = "swi/p", "0123qrtu"

# Letters of lines that open or close a block.
_EVENTS = "swpqrtu"

# From the line after an opening one, up to and including the first that holds
# a block end, every line that is not blank is inside.
_INSIDE = "(?:(?<=s)|\\G(?!^)(?<![wpqrtu]))(b*+)[^b]"


def comment_syntax(ext_key: Column) -> Column:
    """``struct<prefix, start, end>`` of an extension; parts it lacks are null."""

    def part(at: int) -> Column:
        chosen = F.lit(None).cast("string")
        for mark in dict.fromkeys(syntax[at] for syntax in COMMENT_SYNTAX.values()):
            extensions = tuple(e for e, syntax in COMMENT_SYNTAX.items() if syntax[at] == mark)
            chosen = F.when(one_of(ext_key, extensions), F.lit(mark)).otherwise(chosen)
        return chosen

    return F.struct(*[part(i).alias(n) for i, n in enumerate(("prefix", "start", "end"))])


def _line_code(line: Column, syntax: Column) -> Column:
    trimmed = strip(line)
    control, function = F.rlike(line, F.lit(CONTROL_LINE)), F.rlike(line, F.lit(FUNCTION_HEAD))
    # Both patterns need one of these; the test spares most lines the regexes.
    worth = F.contains(line, F.lit("{")) | F.contains(line, F.lit("func"))

    def code(letters: str) -> Column:
        featured = (
            F.when(control & function, letters[3])
            .when(control, letters[2])
            .when(function, letters[1])
            .otherwise(letters[0])
        )
        return F.when(worth, featured).otherwise(letters[0])

    # Null parts make these null, which a condition takes as false.
    has_start, has_end = F.contains(line, syntax["start"]), F.contains(line, syntax["end"])
    by_prefix = syntax["prefix"].isNotNull() & F.startswith(trimmed, syntax["prefix"])
    return (
        F.when(trimmed == "", "b")
        .when(has_start & has_end, "w")
        .when(has_start, "s")
        .when(by_prefix & has_end, "p")
        .when(by_prefix, "/")
        .when(has_end, code("qrtu"))
        .otherwise(code("0123"))
    )


def _own_codes(ext_key: Column, text: Column) -> Column:
    """An array of one: the letters of all lines, each seen by itself."""
    lines = split_lines(text)
    # The inner array binds the syntax once per file instead of once per line.
    return F.transform(
        F.array(comment_syntax(ext_key)),
        lambda syntax: F.array_join(F.transform(lines, lambda line: _line_code(line, syntax)), ""),
    )


def own_codes(ext_key: Column, text: Column) -> Column:
    """One letter per line of ``text``, each line seen by itself."""
    return F.get(_own_codes(ext_key, text), F.lit(0))


def line_codes(ext_key: Column, text: Column) -> Column:
    """One letter per line of ``text`` under the comment syntax of its extension."""
    marked = F.transform(
        _own_codes(ext_key, text),
        lambda c: F.when(F.contains(c, F.lit("s")), F.regexp_replace(c, _INSIDE, "$1i")).otherwise(c),
    )
    return F.get(marked, F.lit(0))


def transition(codes: Column) -> Column:
    """What lines do to the state behind them: true opens a block, false closes it, null neither."""
    last = F.regexp_extract(codes, f"([{_EVENTS}])[^{_EVENTS}]*\\z", 1)
    return F.when(last != "", last == "s")


def codes_after(codes: Column, inside: Column) -> Column:
    """Letters of lines seen by themselves, where the lines before leave a block open or not."""
    opened = F.when(inside, F.concat(F.lit("s"), codes)).otherwise(codes)
    marked = F.when(F.contains(opened, F.lit("s")), F.regexp_replace(opened, _INSIDE, "$1i")).otherwise(opened)
    return F.right(marked, F.length(codes))


def kinds(codes: Column) -> Column:
    """``blank``, ``comment`` or ``code`` for each letter."""
    return F.transform(
        F.split(codes, "", -1),
        lambda c: F.when(c == "b", "blank")
        .when(F.contains(F.lit(COMMENT), c), "comment")
        .otherwise("code"),
    )


def count_letters(codes: Column, letters: str) -> Column:
    return (F.length(codes) - F.length(F.translate(codes, letters, ""))).cast("long")


def score(codes: Column) -> Column:
    """Complexity of the code lines."""
    return (
        count_letters(codes, "23tu") * F.lit(CONTROL_SCORE)
        + count_letters(codes, "13ru") * F.lit(FUNCTION_SCORE)
    )
