"""Ignore-rule files: parsing, and the last matching rule for each path.

A rule's glob is tried on the whole path and on what follows each slash, which
is one regular expression anchored at the start or behind a slash.  Rules with a
``scope`` hold below that directory only, for the path as seen from there.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafledger.functions import globs
from leafledger.functions import paths as P
from leafledger.functions.text import strip
from leafledger.operators.lines import split_lines
from leafledger.operators.running import carried, running_total
from leafledger.operators.spread import spread_join
from leafledger.schema import require
from leafledger.session import shared_dir

KINDS = ("tail", "head", "gram", "inner", "exact", "open")
#: Characters of the pieces by which literals inside a path are looked up: the most that a literal has.
GRAMS = (3, 6)

_TRANSLATION = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("regex", "kind", "anchor")]
)


@F.pandas_udf(_TRANSLATION)
def _translated(patterns: pd.Series) -> pd.DataFrame:
    """Regex of each glob and something whole that every match offers.

    ``tail``: the path ends with the literal; ``head``: it follows the start or a slash;
    ``gram`` and ``inner``: it occurs somewhere, and has at least the characters of a gram or fewer;
    ``exact`` and ``open``: the glob has no literal, and the match has just so many characters,
    or at least so many.
    """

    def one(pattern: str):
        glob = globs.translate(pattern)
        if glob is None:
            return None, "never", ""
        regex = globs.suffix_match(pattern)
        if glob.tail and len(glob.tail) >= len(glob.head):
            return regex, "tail", glob.tail
        if glob.head:
            return regex, "head", glob.head
        if glob.longest:
            return regex, "gram" if len(glob.longest) >= GRAMS[0] else "inner", glob.longest
        return regex, "open" if glob.stars else "exact", str(len(glob.pieces) - glob.stars)

    return pd.DataFrame([one(p) for p in patterns], columns=["regex", "kind", "anchor"])


def ignore_file_lines(corpus: DataFrame, name: str = ".gitignore") -> DataFrame:
    """Lines of every file of the corpus called ``name``."""
    rule_files = require(corpus, "relpath").where(P.base_name(F.col("relpath")) == name)
    return split_lines(rule_files).select("relpath", "line_no", "line")


def rules_of_lines(lines: DataFrame, scoped: bool = False) -> DataFrame:
    """``(walk, line_no, pattern, is_negation, is_dir_only)`` from ``(relpath, line_no, line)``.

    ``walk`` and ``line_no`` order the rules of all files; applying them needs no numbers.  With
    ``scoped`` each rule has its file's directory as ``scope``: it then holds below that directory
    only, rules of deeper files override those of files above, and later lines earlier ones.
    """
    trimmed = strip(F.col("line"))
    place = [P.dir_name(F.col("relpath")).alias("scope")] if scoped else []
    return (
        require(lines, "relpath", "line_no", "line")
        .select(P.walk_key(F.col("relpath")).alias("walk"), "line_no", *place, trimmed.alias("line"))
        .where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
        .withColumn("is_negation", F.startswith("line", F.lit("!")))
        .withColumn("body", F.when(F.col("is_negation"), F.expr("substr(line, 2)")).otherwise(F.col("line")))
        .withColumn("is_dir_only", F.endswith("body", F.lit("/")))
        .withColumn(
            "pattern",
            F.when(F.col("is_dir_only"), F.expr("left(body, length(body) - 1)")).otherwise(F.col("body")),
        )
        .select("walk", "line_no", *(["scope"] if scoped else []), "pattern", "is_negation", "is_dir_only")
    )


def parse_ignore_rules(lines: DataFrame) -> DataFrame:
    """``(rule_no, pattern, is_negation, is_dir_only)`` from ``(relpath, line_no, line)``.

    Rules are numbered through all files in walk order; the numbers come from a
    distributed running count.
    """
    numbered = running_total(rules_of_lines(lines), F.lit(1), ["walk", "line_no"], name="rule_no")
    return numbered.select("rule_no", "pattern", "is_negation", "is_dir_only")


def with_regex(rules: DataFrame) -> DataFrame:
    """Add the rule's regex; null for a malformed glob, which never matches."""
    return rules.withColumn("regex", _translated("pattern")["regex"])


def _depth(scope: Column) -> Column:
    return F.when(scope == "", 0).otherwise(P.depth(scope))


def _distinct_rules(rules: DataFrame) -> DataFrame:
    """Equal rules act alike, so only the last of each can decide; ``at`` is its place."""
    require(rules, "pattern", "is_negation", "is_dir_only")
    scope, at = [], ["walk", "line_no"]
    if "scope" in rules.columns:
        rules, scope, at = rules.withColumn("__depth", _depth(F.col("scope"))), ["scope"], ["__depth", "line_no"]
    elif "rule_no" in rules.columns:
        at = ["rule_no"]
    return require(rules, *at).groupBy(*scope, "pattern", "is_negation", "is_dir_only").agg(F.max(F.struct(*at)).alias("at"))


def _after_slashes(path: Column) -> Column:
    """The path and what follows each of its slashes."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda k: F.array_join(F.slice(parts, k, F.size(parts) - k + 1), "/"),
    )


def _offered(path: Column, kind: str, sizes: Column) -> Column:
    """What a path offers to rules of ``kind``: literals of the given sizes, or sizes."""
    starts = _after_slashes(path)

    def fitting(text: Column) -> Column:
        return F.filter(sizes, lambda n: n <= F.length(text))

    if kind == "tail":
        return F.transform(fitting(path), lambda n: F.right(path, n))
    if kind in ("exact", "open"):
        fits = (lambda n, s: n == F.length(s)) if kind == "exact" else (lambda n, s: n <= F.length(s))
        found = F.filter(sizes, lambda n: F.exists(starts, lambda s: fits(n, s)))
        return F.transform(found, lambda n: n.cast("string"))
    if kind == "head":
        return F.flatten(
            F.transform(starts, lambda s: F.transform(fitting(s), lambda n: F.left(s, n)))
        )
    return F.flatten(
        F.transform(
            fitting(path),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.length(path) - n + 1), lambda i: F.substring(path, i, n)
            ),
        )
    )


def _gram_size(literal: Column) -> Column:
    return F.when(F.length(literal) >= GRAMS[1], GRAMS[1]).otherwise(GRAMS[0])


def _sizes() -> Column:
    """Which sizes of anchor occur, by kind, as an aggregate over rules."""
    size = (
        F.when(F.col("kind").isin("exact", "open"), F.col("anchor").cast("int"))
        .when(F.col("kind") == "gram", _gram_size(F.col("anchor")))
        .otherwise(F.length("anchor"))
    )
    return F.struct(*[F.sort_array(F.collect_set(F.when(F.col("kind") == kind, size))).alias(kind) for kind in KINDS])


def _anchors(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """A row per literal or size a path offers, for all kinds from one scan of the paths.

    Which sizes occur is a subquery over the stored rules, so nothing passes the driver.  A path
    offers at most its grams of ``GRAMS`` characters for all literals inside it that are as long.
    Scoped rules meet what is left of the path below their scope, and offers are those that
    rules of the same scope can take.
    """
    scope = []
    if "scope" in rules.columns:
        seen = _within_scopes(paths, rules).select("relpath", "__is_dir", F.explode("__chain").alias("__in"))
        rows = seen.select("relpath", "__is_dir", "__in.scope", "__in.sizes").withColumnRenamed("sizes", "__sizes")
        below = F.expr("CASE WHEN scope = '' THEN relpath ELSE substr(relpath, length(scope) + 2) END")
        rows, scope = rows.withColumn("__path", below), ["scope"]
    else:
        rows = paths.withColumn("__sizes", rules.agg(_sizes().alias("sizes")).scalar()).withColumn("__path", F.col("relpath"))
    named = [_of_kind(kind, _offered(F.col("__path"), kind, F.col(f"__sizes.{kind}"))) for kind in KINDS]
    return rows.select("relpath", "__is_dir", *scope, "__path", F.inline(F.concat(*named)))


def _of_kind(kind: str, offer: Column) -> Column:
    return F.transform(F.array_distinct(offer), lambda a: F.struct(F.lit(kind).alias("kind"), a.alias("anchor")))


def _chains(rules: DataFrame) -> DataFrame:
    """For each scope ``__chain``: it and the scopes above it, outermost first, with their sizes."""
    scopes = rules.groupBy("scope").agg(_sizes().alias("sizes"))
    parts = F.split("scope", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    lines = scopes.select(F.col("scope").alias("__of"), F.explode(F.array_distinct(above)).alias("scope"))
    met = lines.join(scopes, "scope").withColumn("depth", _depth(F.col("scope")))
    return met.groupBy("__of").agg(F.sort_array(F.collect_list(F.struct("depth", "scope", "sizes"))).alias("__chain"))


def _within_scopes(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``paths`` with ``__chain``, the scopes that hold them; paths in none are left out.

    In the order of a walk all that lies below a directory is one interval.  A scope's start
    and end are rows among the paths: at the start its chain begins to hold and at the end that of the
    scope around it.  The last such row before a path tells its scopes, so paths are sorted by
    ranges once and never meet a scope that does not hold them.
    """
    key = P.walk_key(F.col("__of"))
    chains = _chains(rules)
    starts = chains.select(F.when(F.col("__of") == "", "").otherwise(F.concat(key, F.lit("\x00"))).alias("__walk"), "__chain")
    around = F.slice("__chain", F.lit(1), F.size("__chain") - 1)
    ends = chains.where("__of <> ''").select(F.concat(key, F.lit("\x01")).alias("__walk"), around.alias("__chain"))
    marks = starts.union(ends).select(
        F.lit(None).cast("string").alias("relpath"), F.lit(None).cast("boolean").alias("__is_dir"), "__walk", F.lit(0).alias("__turn"), "__chain"
    )
    none = F.lit(None).cast(marks.schema["__chain"].dataType)
    rows = paths.select("relpath", "__is_dir", P.walk_key(F.col("relpath")).alias("__walk"), F.lit(1).alias("__turn"), none.alias("__chain"))
    seen = carried(rows.union(marks), F.col("__chain"), ["__walk", "__turn"], name="__held")
    return seen.where("__turn = 1 AND size(__held) > 0").select("relpath", "__is_dir", F.col("__held").alias("__chain"))


def _by_rarest_gram(rules: DataFrame) -> DataFrame:
    """Rules with ``literal``, the one to verify, and as ``anchor`` that of its grams which the fewest
    rules (of its scope) have; others keep their anchors and have no ``literal``."""
    size = _gram_size(F.col("anchor"))
    grams = F.transform(F.sequence(F.lit(1), F.length("anchor") - size + 1), lambda i: F.substring(F.col("anchor"), i, size))
    own = [c for c in rules.columns if c != "anchor"]
    literal = F.when(F.col("kind") == "gram", F.col("anchor"))
    offered = F.when(F.col("kind") == "gram", F.array_distinct(grams)).otherwise(F.array("anchor"))
    spread = rules.select(*own, literal.alias("literal"), F.explode(offered).alias("anchor"))
    same = Window.partitionBy(*(["scope"] if "scope" in own else []), "kind", "anchor")
    ranked = spread.withColumn("__shared", F.count(F.lit(1)).over(same))
    return ranked.groupBy(*own, "literal").agg(F.min_by("anchor", F.struct("__shared", "anchor")).alias("anchor"))


def _stored(rules: DataFrame) -> DataFrame:
    """Distinct rules, translated; parsed once and kept in the shared checkpoint folder."""
    folder = f"{shared_dir(rules.sparkSession)}/rules-{uuid.uuid4().hex}"
    scope = ["scope"] if "scope" in rules.columns else []
    parsed = _distinct_rules(rules).withColumn("t", _translated("pattern"))
    parsed = parsed.select(*scope, "at", "is_negation", "is_dir_only", "t.regex", "t.kind", "t.anchor")
    parsed.write.parquet(folder)
    return rules.sparkSession.read.schema(parsed.schema).parquet(folder)


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``relpath`` that the last applicable rule ignores, from ``(relpath, __is_dir)``.

    Each rule is looked up by a literal that its matches contain, or a piece of it, or where it has
    none by their length, so a path meets only rules that it could match.
    """
    parsed = _stored(rules)
    on = [*(["scope"] if "scope" in parsed.columns else []), "kind", "anchor"]
    candidates = spread_join(_anchors(paths, parsed), _by_rarest_gram(parsed), on, F.col("relpath"), "inner")
    applies = F.col("is_negation") | ~F.col("is_dir_only") | F.col("__is_dir")
    holds = F.coalesce(F.contains("__path", "literal"), F.lit(True))
    hits = candidates.where(applies & holds & F.rlike(F.col("__path"), F.col("regex")))
    # Of a rule and its negation in one place, which numbers given by hand allow, the negation counts.
    last = hits.groupBy("relpath").agg(F.max(F.struct("at", "is_negation")).alias("last"))
    return last.where("not last.is_negation").select("relpath")


def with_ignored(df: DataFrame, rules: DataFrame, is_dir: Column | None = None) -> DataFrame:
    """Add ``is_ignored``: the last rule that applies to the path says so.

    A negation that matches keeps the path; a directory-only rule is passed
    over for files.  Rules match the path itself and not what lies above it.
    ``df`` should be narrow: it is joined as it is.
    """
    if is_dir is None:
        require(df, "relpath", "is_dir")
        is_dir = F.col("is_dir")
    ignored = ignored_paths(df.select("relpath", is_dir.alias("__is_dir")), rules)
    return df.join(ignored.withColumn("is_ignored", F.lit(True)), "relpath", "left").withColumn(
        "is_ignored", F.coalesce(F.col("is_ignored"), F.lit(False))
    )


def apply_ignore_rules(entries: DataFrame, rules: DataFrame, inherit: bool = False) -> DataFrame:
    """Entries with ``is_ignored``; with ``inherit`` also below an ignored directory."""
    judged = with_ignored(entries, rules)
    if not inherit:
        return judged
    dropped = judged.where("is_dir and is_ignored").select(F.col("relpath").alias("above")).distinct()
    parts = F.split("relpath", "/")
    below = (
        entries.select(
            "relpath",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.size(parts)),
                    lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
                )
            ).alias("above"),
        )
    )
    hidden = (
        spread_join(below, dropped, ["above"], F.col("relpath"), "inner")
        .select("relpath").distinct().withColumn("__hidden", F.lit(True))
    )
    return (
        judged.join(hidden, "relpath", "left")
        .withColumn("is_ignored", F.col("is_ignored") | F.coalesce(F.col("__hidden"), F.lit(False)))
        .drop("__hidden")
    )
