import re

import pytest

from leafledger.functions import globs


def search(regex, text):
    """Java's ``\\z`` is Python's ``\\Z``."""
    return regex is not None and re.search(regex.replace("\\z", "\\Z"), text) is not None


def hit(pattern, text):
    return search(globs.full_match(pattern), text)


@pytest.mark.parametrize(
    "pattern, text, expected",
    [
        ("*.swp", "scratch.swp", True),
        ("*.swp", "a/scratch.swp", False),
        ("a/*.swp", "a/scratch.swp", True),
        ("**/x", "a/x", True),
        ("**/x", "a/b/x", False),
        ("?.go", "a.go", True),
        ("?.go", "/.go", False),
        ("[a-c]x", "bx", True),
        ("[^a-c]x", "bx", False),
        ("[^a-c]x", "dx", True),
        ("[z-a]x", "bx", False),
        ("\\*x", "*x", True),
        ("\\*x", "ax", False),
        ("a.b", "axb", False),
        ("a+b(c)", "a+b(c)", True),
        ("test_*", "test_file.go", True),
        ("", "", True),
        ("x", "x\n", False),
    ],
)
def test_match(pattern, text, expected):
    assert hit(pattern, text) is expected


@pytest.mark.parametrize("pattern", ["[a", "[]a]", "a\\", "[a-]", "[^]x", "[-a]", "[]"])
def test_malformed_matches_nothing(pattern):
    assert globs.full_match(pattern) is None
    assert globs.suffix_match(pattern) is None


def test_suffixes():
    regex = globs.suffix_match("b/*.c")
    for path, expected in (("b/x.c", True), ("a/b/x.c", True), ("a/bb/x.c", False), ("b/x.c/d", False)):
        assert search(regex, path) is expected


def test_literals():
    glob = globs.translate("test_*.lo[gG]")
    assert (glob.head, glob.tail, glob.longest) == ("test_", "", "test_")
    assert globs.translate("build").head == globs.translate("build").tail == "build"


def test_comma_list():
    assert globs.comma_list(" go , md ,txt") == ["go", "md", "txt"]
    assert globs.comma_list(None) == [] == globs.comma_list("")
