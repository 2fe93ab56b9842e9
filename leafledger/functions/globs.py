"""Shell-style globs as regular expressions.

``*`` and ``?`` stop at a slash, ``[a-z]`` and ``[^a]`` are classes, a
backslash takes the next character literally and ``**`` equals ``*``.  A
malformed glob has no regex and matches nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<star>\*+)
      | (?P<one>\?)
      | \[(?P<not>\^?+)(?P<set>(?:(?:\\.|[^\\\]\-])(?:-(?:\\.|[^\\\]\-]))?)+)\]
      | \\(?P<escaped>.)
      | (?P<plain>[^*?\[\\])""",
    re.VERBOSE | re.DOTALL,
)
_RANGE = re.compile(r"(\\.|[^\\])(?:-(\\.|[^\\]))?", re.DOTALL)


@dataclass(frozen=True)
class Glob:
    """A translated glob: its regex body and its literal runs in order.

    ``pieces`` holds literal text and ``None`` for each wildcard or class; ``stars`` counts
    the runs of ``*`` among these.
    """

    regex: str
    pieces: tuple[str | None, ...]
    stars: int = 0

    @property
    def head(self) -> str:
        return self.pieces[0] if self.pieces and self.pieces[0] else ""

    @property
    def tail(self) -> str:
        return self.pieces[-1] if self.pieces and self.pieces[-1] else ""

    @property
    def longest(self) -> str:
        return max((p for p in self.pieces if p), key=len, default="")


def _quote(char: str) -> str:
    """A literal for Java and Python regexes alike."""
    return char if char.isalnum() or char in "_/" or ord(char) > 127 else f"\\x{ord(char):02x}"


def _class(body: str, negated: bool) -> str:
    spans = []
    for low, high in _RANGE.findall(body):
        low, high = low[-1], (high or low)[-1]
        if low <= high:
            spans.append(_quote(low) if low == high else f"{_quote(low)}-{_quote(high)}")
    if not spans:
        return "[\\s\\S]" if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(spans)}]"


def translate(pattern: str) -> Glob | None:
    """The glob's regex and literal pieces, ``None`` if it is malformed."""
    at, stars, regex, pieces = 0, 0, [], []
    while at < len(pattern):
        token = _TOKEN.match(pattern, at)
        if token is None:
            return None
        at = token.end()
        literal = token["plain"] or token["escaped"]
        if literal is not None:
            regex.append(_quote(literal))
            if pieces and pieces[-1] is not None:
                pieces[-1] += literal
            else:
                pieces.append(literal)
            continue
        pieces.append(None)
        if token["star"]:
            regex.append("[^/]*")
            stars += 1
        elif token["one"]:
            regex.append("[^/]")
        else:
            regex.append(_class(token["set"], bool(token["not"])))
    return Glob("".join(regex), tuple(pieces), stars)


def full_match(pattern: str) -> str | None:
    """Regex that must cover the whole text."""
    glob = translate(pattern)
    return None if glob is None else f"\\A(?:{glob.regex})\\z"


def suffix_match(pattern: str) -> str | None:
    """Regex that must cover the text or what follows one of its slashes."""
    glob = translate(pattern)
    return None if glob is None else f"(?:\\A|/)(?:{glob.regex})\\z"


def comma_list(value: str | Iterable[str] | None) -> list[str]:
    """``"a, b"`` or an iterable as a list of trimmed entries; nothing gives ``[]``."""
    if not value:
        return []
    entries: Iterator[str] = iter(value.split(",")) if isinstance(value, str) else iter(value)
    return [entry.strip() for entry in entries]
