import random
import re

from leafledger.functions import globs
from leafledger.operators import ignore

RULE = "rule_no long, pattern string, is_negation boolean, is_dir_only boolean"
RULE_LINES = ["*.bak", "!keep.bak", "cache/", "draft-?.md", "!draft-7.md", "out*/"]


def parsed(spark, lines, path=".gitignore"):
    rows = spark.createDataFrame([(path, i + 1, line) for i, line in enumerate(lines)],
                                 "relpath string, line_no int, line string")
    return ignore.parse_ignore_rules(rows)


def entries(spark, items):
    return spark.createDataFrame(items, "relpath string, is_dir boolean")


def ignored(df):
    return sorted(r.relpath for r in df.where("is_ignored").collect())


def test_parsing(spark):
    lines = ["# comment", "", "  *.log  ", "   # indented", "!keep.log", "build/", "!dist/", "/", "\t"]
    rows = [tuple(r) for r in parsed(spark, lines).orderBy("rule_no").collect()]
    assert rows == [
        (1, "*.log", False, False), (2, "keep.log", True, False), (3, "build", False, True),
        (4, "dist", True, True), (5, "", False, True),
    ]


def test_files_are_numbered_in_walk_order(spark):
    rows = spark.createDataFrame(
        [("b/.gitignore", 1, "three"), (".gitignore", 2, "two"), (".gitignore", 1, "one"), ("a-b/.gitignore", 1, "x"),
         ("a/.gitignore", 1, "y")],
        "relpath string, line_no int, line string")
    assert [r.pattern for r in ignore.parse_ignore_rules(rows).orderBy("rule_no").collect()] == [
        "one", "two", "y", "x", "three"]


def test_lines_come_from_the_rule_files_of_a_corpus(corpus):
    files = corpus({".gitignore": "*.log\n!a.log\n", "x/.gitignore": "b", "other": "c"})
    assert sorted(r.line for r in ignore.ignore_file_lines(files).collect()) == ["!a.log", "*.log", "b"]


def test_decisions(spark):
    items = [(p, False) for p in ("old.bak", "keep.bak", "deep/keep.bak", "draft-1.md", "draft-7.md", "draft-10.md",
                                  "cache", "notes.txt", "x/output")]
    items += [("cache", True), ("deep/cache", True), ("output", True), ("source", True)]
    got = ignore.apply_ignore_rules(entries(spark, list(dict(items).items())), parsed(spark, RULE_LINES))
    assert ignored(got) == ["cache", "deep/cache", "draft-1.md", "old.bak", "output"]


def test_inherit(spark):
    items = [("build", True), ("build/a", False), ("build/x/b", False), ("c", False)]
    got = ignore.apply_ignore_rules(entries(spark, items), parsed(spark, ["build/"]), inherit=True)
    assert ignored(got) == ["build", "build/a", "build/x/b"]


def brute(path, is_dir, rules):
    ends = [path] + [path[i + 1:] for i, c in enumerate(path) if c == "/"]
    for _, pattern, negation, only_dir in sorted(rules, reverse=True):
        regex = globs.full_match(pattern)
        if regex and any(re.search(regex.replace("\\z", "\\Z"), e) for e in ends):
            if negation:
                return False
            if not only_dir or is_dir:
                return True
    return False


def test_random_rules_against_brute_force(spark):
    rng = random.Random(3)
    part = ["a", "ab", "b.c", "*", "?", "a*", "*c", "*b*", "[ab]", "[^a]", "x", "b?c", "[a", "**", "?*"]
    rules = [
        (n, "/".join(rng.choices(part, k=rng.choice([1, 1, 1, 2, 3]))), rng.random() < 0.3, rng.random() < 0.3)
        for n in range(1, 41)
    ]
    names = ["a", "ab", "b.c", "x", "abc", "bxc", "c", "xbx"]
    items = {"/".join(rng.choices(names, k=rng.randrange(1, 5))): rng.random() < 0.5 for _ in range(150)}
    for first in range(0, 40, 10):
        some = rules[first:first + rng.randrange(1, 11)]
        got = ignore.apply_ignore_rules(entries(spark, list(items.items())), spark.createDataFrame(some, RULE))
        assert ignored(got) == sorted(p for p, d in items.items() if brute(p, d, some)), some


def test_a_long_literal_acts_alike_among_few_and_many_rules(spark):
    name = "n" * 5000
    for count in (5, 600):
        rows = [(i, f"other{i}", False, False) for i in range(count)] + [(count, name, False, False)]
        got = ignore.apply_ignore_rules(entries(spark, [(f"d/{name}", False), ("x", False)]), spark.createDataFrame(rows, RULE))
        assert ignored(got) == [f"d/{name}"]


def test_rules_with_one_stem_do_not_multiply_with_paths(spark):
    rules = spark.range(10_000).selectExpr("id AS rule_no", "'*tes' || id || '_*' AS pattern", "false AS is_negation", "false AS is_dir_only")
    paths = spark.range(200).selectExpr("'a/tes' || id || '_x' AS relpath", "false AS __is_dir")
    stored = ignore._stored(rules)
    met = ignore._anchors(paths, stored).join(ignore._by_rarest_gram(stored), ["kind", "anchor"])
    assert met.count() <= 3 * 200
    assert ignore.ignored_paths(paths, rules).count() == 200


def test_rules_without_literals(spark):
    rules = spark.createDataFrame([(1, "?", False, False), (2, "[ab]?*", False, False), (3, "??", True, False)], RULE)
    got = ignore.apply_ignore_rules(entries(spark, [(p, False) for p in ("x", "d/y", "ab", "abc", "d/bcd", "cde")]), rules)
    assert ignored(got) == ["abc", "d/bcd", "d/y", "x"]


def test_building_a_selection_starts_few_jobs(spark, sf_dir):
    """Beyond what it takes to open the tables."""
    from leafledger.operators import select
    from leafledger.plans import registry
    from leafledger.sources import tables

    files, spec = tables.corpus(spark, sf_dir), registry._spec(spark, sf_dir)
    spark.sparkContext.setJobGroup("building", "building")
    select.select_files(files, spec)
    started = len(spark.sparkContext.statusTracker().getJobIdsForGroup("building"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert started <= 5


def test_no_rules(spark):
    got = ignore.apply_ignore_rules(entries(spark, [("a", False)]), spark.createDataFrame([], RULE))
    assert ignored(got) == []


def test_regex_column(spark):
    rules = spark.createDataFrame([(1, "*.log", False, False), (2, "[bad", False, False)], RULE)
    regexes = {r.pattern: r.regex for r in ignore.with_regex(rules).collect()}
    assert regexes == {"*.log": globs.suffix_match("*.log"), "[bad": None}


SCOPED_RULE = "scope string, line_no int, pattern string, is_negation boolean, is_dir_only boolean"


def scoped_brute(path, is_dir, rules):
    """The deepest scope with a rule that matches what follows it, and there the last line."""
    held = [r for r in rules if not r[0] or path.startswith(r[0] + "/")]
    for scope, _, pattern, negation, only_dir in sorted(held, key=lambda r: (r[0].count("/") + bool(r[0]), r[1]), reverse=True):
        seen = path[len(scope) + 1:] if scope else path
        if brute(seen, True, [(0, pattern, False, False)]) and (negation or is_dir or not only_dir):
            return not negation
    return False


def test_scoped_rules_against_brute_force(spark):
    rng = random.Random(8)
    part = ["a", "ab", "b.c", "*", "a*", "*c", "*b*", "[ab]", "x", "b?c", "*xbx*", "?bxc*", "*long-name*"]
    names = ["a", "ab", "b.c", "x", "abc", "bxc", "xbxc", "a-long-name-1", "a\x01", "a!b"]
    for _ in range(2):
        items = {"/".join(rng.choices(names, k=rng.randrange(1, 6))): rng.random() < 0.5 for _ in range(250)}
        scopes = rng.sample([p for p in items if "/" in p or rng.random() < 0.5], 25) + ["", "a", "a/a", "a\x01"]
        rules = [
            (rng.choice(scopes), n, "/".join(rng.choices(part, k=rng.choice([1, 1, 2]))), rng.random() < 0.4, rng.random() < 0.2)
            for n in range(120)
        ]
        got = ignore.apply_ignore_rules(entries(spark, list(items.items())), spark.createDataFrame(rules, SCOPED_RULE))
        want = sorted(p for p, d in items.items() if scoped_brute(p, d, rules))
        assert ignored(got) == want and want


def test_a_scope_holds_below_its_directory_only(spark):
    lines = spark.createDataFrame(
        [("a/.gitignore", 1, "*.log"), ("a/b/.gitignore", 1, "!keep.log"), ("a/b/.gitignore", 2, "c/d"), ("z/.gitignore", 1, "a")],
        "relpath string, line_no int, line string")
    items = [(p, False) for p in ("x.log", "a/x.log", "a/b/x.log", "a/b/keep.log", "a/keep.log", "a-b/x.log", "ab/x.log", "a/b/c/d", "a/c/d", "a", "z/a")]
    got = ignore.apply_ignore_rules(entries(spark, items), ignore.rules_of_lines(lines, scoped=True))
    assert ignored(got) == ["a/b/c/d", "a/b/x.log", "a/keep.log", "a/x.log", "z/a"]


def test_scopes_are_found_without_exploding_ancestors(spark):
    """Paths in no scope meet no rule and offer nothing."""
    rules = spark.createDataFrame([("p/q", 1, "*.x", False, False)], SCOPED_RULE)
    paths = spark.range(500).selectExpr("'p/' || IF(id % 50 = 0, 'q', 'r') || '/f' || id || '.x' AS relpath", "false AS __is_dir")
    assert ignore._anchors(paths, ignore._stored(rules)).count() == 10
    assert ignore.ignored_paths(paths, rules).count() == 10


def test_a_path_offers_its_grams_whatever_the_number_of_literals(spark):
    rules = spark.range(300).selectExpr(
        "id AS rule_no", "'*' || repeat('k', CAST(id % 90 AS INT)) || 'mn' || id || '*' AS pattern", "false AS is_negation", "false AS is_dir_only")
    path = "abcdefghij" * 17
    paths = spark.createDataFrame([(path, False), ("q/kkmn2", False), ("q/kmn1x", False)], "relpath string, __is_dir boolean")
    offered = ignore._anchors(paths, ignore._stored(rules)).groupBy("relpath").count().collect()
    assert {r.relpath: r["count"] for r in offered}[path] <= sum(len(path) - size + 1 for size in ignore.GRAMS)
    assert sorted(r.relpath for r in ignore.ignored_paths(paths, rules).collect()) == ["q/kkmn2", "q/kmn1x"]


def test_the_rarest_gram_is_the_anchor(spark):
    rules = spark.createDataFrame([(i, f"*commonly{i}*", False, False) for i in range(10, 40)], RULE)
    stored = ignore._by_rarest_gram(ignore._stored(rules)).collect()
    assert all(r.literal == f"commonly{i}" for i, r in enumerate(sorted(stored, key=lambda r: r.literal), 10))
    assert max(sum(o.anchor == r.anchor for o in stored) for r in stored) <= 3
