"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

Paragraphs are lines, cut further at places that their content defines. Only SQL functions work on
documents. Sketches of two versions subtract cell by cell; peeling the difference gives the digests
of the paragraphs in which they differ. Where peeling stops early, larger sketches are made, until it
does not.

A sketch is the list of its cells that are not empty, by place. It is made by sorting
(place, digest) entries and adding up those of one place; subtracting and peeling add entries in
the same way, so that all steps grow in proportion to the digests and not to the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafledger.llm.shared import col

#: Cells of a fingerprint; a third of them for each of the three places of a digest.
CELLS = 36
#: Peeling rounds, each over one third of the cells after the other; a sketch with room enough needs few.
ROUNDS = 24
#: The thirds that larger sketches peel, in turn: two tell nearly all differences.
TURNS = (0, 1, 0, 1, 2) * 5
#: A larger sketch has so many cells for each digest that is thought to differ, and a failed one is
#: followed by one of four times the size.
ROOM = 2
GROWTH = 4
#: Sizes grow beyond any array before these end; then two digests have equal hashes, an error.
TRIES = 14
#: Units that a rolling hash covers, and one of how many hashes ends a piece of a line; lines of
#: at most ``WINDOW`` units stay whole.
WINDOW = 4
DIVISOR = 8
#: A unit is a word, or one character of scripts without spaces or of no word, with the white
#: space before it; an unbroken run of letters is cut from its start. The usual letters are named first, as
#: they need no search for their script.
UNIT = r"(?s)\s*+[[a-zA-Z0-9\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF][\p{L}\p{M}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]]]{1,24}+|\s*."


def _pieces(line: Column) -> Column:
    """Digests of the pieces of a line: one ends after a unit where the hash of the last
    ``WINDOW`` units is a multiple of ``DIVISOR``, whatever stands before."""

    def cut(u: Column) -> Column:
        ends = F.filter(
            F.sequence(F.lit(0), F.size(u) - 1),
            lambda i: (i == F.size(u) - 1)
            | ((i >= WINDOW - 1) & (F.pmod(F.xxhash64(*[F.get(u, i - j) for j in reversed(range(WINDOW))]), F.lit(DIVISOR)) == 0)),
        )
        return F.transform(F.array(ends), lambda e: F.transform(e, lambda end, j: F.transform(
            F.array(F.when(j == 0, F.lit(0)).otherwise(F.get(e, j - 1) + 1)),
            lambda start: F.slice(u, start + 1, end - start + 1),
        )[0]))[0]

    cuts = F.transform(F.array(F.regexp_extract_all(line, F.lit(UNIT), F.lit(0))), cut)[0]
    return F.transform(F.filter(cuts, lambda p: F.exists(p, lambda u: F.trim(u) != "")), lambda p: F.xxhash64(p))


def _digests(text: Column) -> Column:
    """Digests of the non-blank pieces of the lines of a text, repeats included."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: F.trim(line) != "")
    return F.flatten(F.transform(lines, _pieces))


def paragraphs(text: Column) -> Column:
    """Digests of the distinct non-blank pieces of the lines of a text."""
    return F.array_distinct(_digests(text))


def _bound(value: Column, used) -> Column:
    """``used`` of a value that is computed once, however often it stands there."""
    return F.transform(F.array(value), used)[0]


def _entry(place: Column, n: Column, key: Column, check: Column) -> Column:
    return F.struct(place.cast("long").alias("p"), n.cast("int").alias("n"), key.alias("k"), check.alias("h"))


def _check(key: Column, salt: Column) -> Column:
    return F.xxhash64(key, salt + 99)


def _third(size: Column | int) -> Column:
    return F.lit(size // 3) if isinstance(size, int) else F.floor(size / 3)


def _place(key: Column, j: Column | int, third: Column, salt: Column) -> Column:
    return F.pmod(F.xxhash64(key, salt + j), third) + j * third


def _entries(keys: Column, n: int, third: Column, salt: Column) -> Column:
    """What digests put into a sketch: themselves and a check sum, in one cell of each third."""
    return F.flatten(F.transform(keys, lambda k: _bound(_check(k, salt), lambda h: F.array(
        *[_entry(_place(k, j, third, salt), F.lit(n), k, h) for j in range(3)]
    ))))


def _summed(entries: Column) -> Column:
    """Cells of entries: counts added, digests and check sums combined by xor; empty cells left out."""

    def cells(e: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i == 0) | (e[i]["p"] != e[i - 1]["p"]))

        def cell(at: Column, s: Column, j: Column) -> Column:
            end = F.coalesce(F.get(at, j + 1), F.size(e))
            return F.when(end == s + 1, e[s]).otherwise(F.aggregate(
                F.slice(e, s + 2, end - s - 1), e[s],
                lambda c, x: _entry(c["p"], c["n"] + x["n"], c["k"].bitwiseXOR(x["k"]), c["h"].bitwiseXOR(x["h"])),
            ))

        return _bound(starts, lambda at: F.transform(at, lambda s, j: cell(at, s, j)))

    found = _bound(F.sort_array(entries), lambda e: F.when(F.size(e) == 0, e).otherwise(cells(e)))
    return F.filter(found, lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["h"] != 0))


def sketch(keys: Column, size: Column | int = CELLS, salt: Column | int = 0) -> Column:
    """Cells (place, count, xor of digests, xor of check sums) of an array of distinct digests."""
    return _summed(_entries(keys, 1, _third(size), F.lit(salt) if isinstance(salt, int) else salt))


def fingerprint(keys: Column) -> Column:
    """``sketch(keys)``, made cell by cell: few cells need no sorting."""
    third, salt = _third(CELLS), F.lit(0)

    def cell(p: Column, own: Column) -> Column:
        xor = lambda of: F.aggregate(own, F.lit(0).cast("long"), lambda t, k: t.bitwiseXOR(of(k)))
        return _entry(p, F.size(own), xor(lambda k: k), xor(lambda k: _check(k, salt)))

    def cells(j: int) -> Column:
        every = F.sequence(F.lit(j * (CELLS // 3)), F.lit((j + 1) * (CELLS // 3) - 1))
        return _bound(F.transform(keys, lambda k: _place(k, j, third, salt)), lambda at: F.transform(
            every, lambda p: _bound(F.filter(keys, lambda k, i: at[i] == p), lambda own: cell(p, own))))

    return F.filter(F.concat(*[cells(j) for j in range(3)]), lambda c: c["n"] != 0)


def subtracted(a: Column, b: Column) -> Column:
    return _summed(F.concat(a, F.transform(b, lambda c: _entry(c["p"], -c["n"], c["k"], c["h"]))))


def _pure(cell: Column, salt: Column) -> Column:
    return (F.abs(cell["n"]) == 1) & (_check(cell["k"], salt) == cell["h"])


def peeled(cells: Column, size: Column | int = CELLS, salt: Column | int = 0) -> Column:
    """Array of (digest, side) that a difference of sketches holds, side 1 for the first and -1
    for the second version; null if peeling stops before all cells are empty."""
    third, salt = _third(size), F.lit(salt) if isinstance(salt, int) else salt
    none = F.array().cast("array<struct<k:bigint,n:int>>")

    def step(state: Column, turn: Column) -> Column:
        # a digest has one cell in a third, so none is found twice
        ones = F.filter(state["cells"], lambda c: (c["p"] >= turn * third) & (c["p"] < (turn + 1) * third) & _pure(c, salt))
        taken = lambda some: F.flatten(F.transform(some, lambda c: F.array(*[
            _entry(_place(c["k"], j, third, salt), -c["n"], c["k"], c["h"]) for j in range(3)
        ])))
        # each step copies the state: what does not peel is forgotten but for one cell
        stuck = F.struct(F.slice(state["cells"], 1, 1).alias("cells"), none.alias("found"), F.lit(3).alias("idle"))
        idle = F.struct(state["cells"].alias("cells"), state["found"].alias("found"), (state["idle"] + 1).alias("idle"))
        return F.when((state["idle"] >= 3) | (F.size(state["cells"]) == 0), state).otherwise(_bound(ones, lambda some: F.when(
            F.size(some) == 0, F.when(state["idle"] == 2, stuck).otherwise(idle),
        ).otherwise(F.struct(
            _summed(F.concat(state["cells"], taken(some))).alias("cells"),
            F.concat(state["found"], F.transform(some, lambda c: F.struct(c["k"].alias("k"), c["n"].alias("n")))).alias("found"),
            F.lit(0).alias("idle"),
        ))))

    start = F.struct(cells.alias("cells"), none.alias("found"), F.lit(0).alias("idle"))
    turns = F.array(*[F.lit(i % 3) for i in range(ROUNDS)])
    return F.aggregate(turns, start, step, lambda s: F.when(F.size(s["cells"]) == 0, s["found"]))


def _peeled_by_thirds(a: Column, b: Column, third: Column, salt: Column) -> Column:
    """How many digests a large difference of sketches of two arrays of digests holds; -1 if peeling stops.

    Every third of a sketch holds all digests, so a third is summed when its turn comes, less what was
    found by then, and cells of one digest leave it; the difference is known when a third is empty.
    """
    cell = "array<struct<p:bigint,n:int,k:bigint,h:bigint>>"
    none, unseen = F.array().cast(cell), F.array(*[F.lit(None).cast(cell)] * 3)

    def step(state: Column, j: Column) -> Column:
        place = lambda k: F.pmod(F.xxhash64(k, salt + j), third)
        of = lambda keys, n: F.transform(keys, lambda k: _entry(place(k), F.lit(n), k, _check(k, salt)))
        seen = state["seen"][j]
        new = F.slice(state["found"], seen + 1, F.size(state["found"]) - seen)
        less = F.transform(new, lambda c: _entry(place(c["k"]), -c["n"], c["k"], c["h"]))
        held = _summed(F.concat(F.coalesce(state["rest"][j], F.concat(of(a, 1), of(b, -1))), less))

        def after(cells: Column) -> Column:
            ones = F.filter(cells, lambda c: _pure(c, salt))
            rest = F.filter(cells, lambda c: ~_pure(c, salt))
            more = F.size(state["found"]) + F.size(ones)
            return F.when(F.size(rest) == 0, F.struct(
                unseen.alias("rest"), none.alias("found"), state["seen"].alias("seen"), more.alias("d"),
            )).otherwise(F.struct(
                F.transform(state["rest"], lambda r, i: F.when(i == j, rest).otherwise(r)).alias("rest"),
                F.concat(state["found"], ones).alias("found"),
                F.transform(state["seen"], lambda x, i: F.when(i == j, more).otherwise(x)).alias("seen"), F.lit(-1).alias("d"),
            ))

        return F.when(state["d"] >= 0, state).otherwise(_bound(held, after))

    start = F.struct(unseen.alias("rest"), none.alias("found"), F.array(*[F.lit(0)] * 3).alias("seen"), F.lit(-1).alias("d"))
    return F.aggregate(F.array(*[F.lit(j) for j in TURNS]), start, step, lambda s: s["d"])


def difference(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """How many digests only one of two arrays has, as peeled from their sketches.

    Where the fingerprints are too small, the squared counts of their difference tell about how many
    digests differ (each adds one to three cells), hence how large the next sketches are to be.
    """

    def larger(first: Column) -> Column:
        about = F.aggregate(first, F.lit(0).cast("long"), lambda t, c: t + c["n"].cast("long") * c["n"])
        start = F.struct(_third(about * ROOM + 4 * CELLS).alias("third"), F.lit(-1).alias("d"))

        def attempt(state: Column, i: Column) -> Column:
            third, salt = state["third"], i * 1000
            tried = F.struct((third * GROWTH).alias("third"), _peeled_by_thirds(a, b, third, salt).alias("d"))
            return F.when(state["d"] >= 0, state).otherwise(tried)

        return F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), start, attempt, lambda s: s["d"])

    def whole(first: Column) -> Column:
        return _bound(peeled(first), lambda p: F.when(p.isNotNull(), F.size(p)).otherwise(larger(first)))

    failed = F.raise_error(F.lit("two paragraph digests have equal hashes")).cast("int")
    return _bound(_bound(subtracted(cells_a, cells_b), whole), lambda d: F.when(d >= 0, d).otherwise(failed))


def likeness(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """Shared share of all distinct paragraphs, from sizes and difference; 1 for two empty ones."""
    total = F.size(a) + F.size(b)
    same = F.transform(F.array(difference(a, b, cells_a, cells_b)), lambda d: (total - d) / (total + d))[0]
    return F.when(total == 0, F.lit(1.0)).otherwise(same.cast("double"))


def printed(cells: Column) -> Column:
    """The sketch as text: place, count, digests and check sums of each cell in hexadecimal."""
    hex_ = lambda c, width: F.lpad(F.hex(c), width, "0")
    cell = lambda c: F.concat(hex_(c["p"], 2), hex_(c["n"], 6), hex_(c["k"], 16), hex_(c["h"], 16))
    return F.lower(F.array_join(F.transform(cells, cell), ""))


def _bucket(bounds: list[int]) -> Column:
    """Number of bounds below an id, by binary search; null ids come last, in bucket -1."""
    if not bounds:
        return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.lit(0))
    steps = len(bounds).bit_length()
    listed = ",".join(f"{b}L" for b in bounds)
    return F.expr(
        f"""CASE WHEN doc_id IS NULL THEN -1 ELSE element_at(transform(array(array({listed})), bs -> aggregate(sequence(1, {steps}),
        named_struct('lo', 0, 'hi', size(bs)),
        (s, x) -> CASE WHEN s.lo >= s.hi THEN s
          WHEN bs[(s.lo + s.hi) div 2] < doc_id THEN named_struct('lo', cast((s.lo + s.hi) div 2 + 1 AS int), 'hi', s.hi)
          ELSE named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 AS int)) END, s -> s.lo)), 1) END"""
    )


def with_next(docs: DataFrame, ranges: int | None = None, derived=None) -> DataFrame:
    """``doc_id``, ``text``, ``next_text``: the text of the next row by descending id.

    Ids are cut into ranges at quantiles; rows find their successor within their range, and the
    last of a range takes the first of the range below. Null ids come last; after the last row
    comes the first. Rows with one id are ordered by a hash of their text. The number of ranges
    is that of the shuffle partitions, so what the driver and the broadcast hold is bounded by it.
    A range is a task, and texts are shuffled once. Columns that ``derived`` adds to a table with
    a ``text`` are reckoned after that, once a row, and come twice, for the next row as ``next_...``.
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    derived = derived or (lambda rows: rows)
    shares = [i / ranges for i in range(1, ranges)]
    bounds = []
    if shares:
        row = docs.agg(F.percentile_approx("doc_id", shares, 10_000).alias("q")).head()
        bounds = sorted(set(row.q or []))
    placed = docs.select("doc_id", "text").withColumn("bucket", _bucket(bounds)).withColumn("hash", F.xxhash64("text"))
    heads = placed.groupBy("bucket").agg(F.max(F.struct("doc_id", "hash")).alias("top"))
    followed = heads.selectExpr(
        "bucket",
        "coalesce(lead(top) OVER (ORDER BY bucket DESC), first_value(top) OVER (ORDER BY bucket DESC)) AS next",
    ).select("bucket", F.col("next.doc_id").alias("next_id"), F.col("next.hash").alias("next_hash"))
    match = placed["doc_id"].eqNullSafe(F.col("next_id")) & (placed["hash"] == F.col("next_hash"))
    wanted = followed.select("next_id", "next_hash").distinct()
    texts = placed.join(F.broadcast(wanted), match).select("next_id", "next_hash", "text").dropDuplicates(["next_id", "next_hash"])
    rows = derived(placed.repartitionById(ranges, F.col("bucket")))
    of_text = [c for c in rows.columns if c not in ("doc_id", "bucket", "hash")]
    texts = derived(texts).select("next_id", "next_hash", F.struct(*of_text).alias("head"))
    same = F.col("f.next_id").eqNullSafe(F.col("t.next_id")) & (F.col("f.next_hash") == F.col("t.next_hash"))
    below = followed.alias("f").join(texts.alias("t"), same).select(F.col("f.bucket").alias("head_bucket"), "head")
    ordered = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.col("hash").desc())
    rows = rows.select("doc_id", "bucket", *of_text, F.lead(F.struct(*of_text)).over(ordered).alias("after"))
    joined = rows.join(F.broadcast(below), (F.col("bucket") == F.col("head_bucket")) & F.col("after").isNull(), "left")
    joined = joined.select("doc_id", *of_text, F.coalesce("after", "head").alias("next"))
    return joined.select("doc_id", *of_text, *[F.col(f"next.{c}").alias(f"next_{c}") for c in of_text])


def _sketched(rows: DataFrame) -> DataFrame:
    """Adds the measures of a ``text``, its digests ``keys`` and ``cells``, and ``start``, the digests of the
    lines that end before its last third and stay the same when that is replaced."""
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("third", F.floor(F.length("text") / 3).cast("int"))
    kept = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - F.col("third"))
    rows = rows.withColumn("cut", F.length(kept) - F.length(F.substring_index(kept, "\n", -1)))
    rows = rows.withColumn("start", _digests(F.substring(F.col("text"), F.lit(1), F.col("cut"))))
    rows = rows.withColumn("keys", F.array_distinct(F.concat("start", _digests(F.substring(F.col("text"), F.col("cut") + 1, F.length("text"))))))
    return rows.withColumn("cells", fingerprint(F.col("keys")))


def compare_versions(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``n_chars``, ``edited``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next`` per row of ``docs``.

    The edited text has its last third (rounded down, in code points) replaced by the start of
    the next document by descending id. A fingerprint is the sketch of the text's distinct
    pieces (non-blank lines, cut where their content says), so equal texts have equal ones;
    likeness is the shared share of these pieces. Null texts are empty; two texts without a
    piece are alike (1). Every likeness is that of a peeled difference. Repeated rows and ids
    keep a row each; other columns are not looked at. An empty table gives an empty result.
    """
    text = F.coalesce(col(text_column).cast("string"), F.lit(""))
    spark = docs.sparkSession
    # a range is a task, which takes time rather than bytes, by which adaptive execution would merge tasks
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = with_next(docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text")), ranges, _sketched)
    kept = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - F.col("third"))
    rows = rows.withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), F.col("third"))))
    rest = F.substring(F.col("edited"), F.col("cut") + 1, F.length("edited"))
    rows = rows.withColumn("new_keys", F.array_distinct(F.concat("start", _digests(rest))))
    rows = rows.withColumn("new_cells", fingerprint(F.col("new_keys")))
    like = lambda other: likeness(*[F.col(f"{x}{what}") for what in ("keys", "cells") for x in ("", other)])
    return rows.select(
        "doc_id", "n_chars", "edited", printed(F.col("cells")).alias("fingerprint"), printed(F.col("new_cells")).alias("edited_fingerprint"),
        like("new_").alias("near_edited"), like("next_").alias("near_next"),
    )
