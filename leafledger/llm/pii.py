"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a
classifier trained on the outcome decides about spans that the base patterns do not cover.

All work on documents is done by SQL functions; the driver sees vote patterns and feature
sums, whose numbers are fixed by the labelers and not by the data.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafledger.llm.shared import col, stored

KINDS = ("email", "ip", "card", "phone")

# A match never starts inside a run of its first class except where the last one ended, and no
# run gives characters back: the matches are those of the plain pattern, found in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}

# Wider candidates, for the labelers to judge.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:(?:\x20?[(\[]dot[)\]]\x20?|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
WIDE_HINT = {"email": r"[(\[]at[)\]]", "ip": r"\[\.\][0-9]", "card": "[0-9]{13}", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}

#: Characters before a match that the context labeler reads.
CONTEXT = 32
CUES = {
    "email": "mail|contact|write|schreib|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|addr|login|from",
    "card": "card|visa|master|amex|pay|karte|carte|tarjeta|credit",
    "phone": "tel|phone|call|fax|mobil|whatsapp|sms|ruf|appel",
}
#: Endings of domains, networks, first digits of card numbers and country codes that are in use.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[)\]]\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0|10\b|127\b|255\b|169\.254|192\.168)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^\+(?:1|7|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
}
#: A name that keys and passwords go by, given a value of letters, digits and signs.
SECRET = (
    r"(?i)(?<![a-z0-9])(?:token|secret|passw(?:or)?d|pwd|(?:api|access|private)[_-]?key|credential)s?[\x22']?"
    r"\x20{0,2}[:=]\x20{0,2}[\x22']?[a-z0-9+/=_.-]{16,}"
)
LABELERS = 5
ROUNDS = 40
#: Probability from which a span that no base pattern covers is reported.
THRESHOLD = 0.9

_octet = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _matches(text: Column, pattern: str, hint: str) -> Column:
    """Array of (start, end, value, before, after), in code points, end exclusive.

    The texts between matches give the places of the matches and their surroundings.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(both: Column) -> Column:
        v, g = both["v"], both["g"]
        index = F.sequence(F.lit(0), F.size(v) - 1)
        starts = F.aggregate(
            index,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
            lambda acc, i: F.struct(
                (acc["at"] + F.length(F.get(g, i)) + F.length(F.get(v, i))).alias("at"),
                F.concat(acc["starts"], F.array(acc["at"] + F.length(F.get(g, i)))).alias("starts"),
            ),
            lambda acc: acc["starts"],
        )
        return F.transform(F.array(starts), lambda s: F.transform(index, lambda i: F.struct(
            F.get(s, i).alias("start"),
            (F.get(s, i) + F.length(F.get(v, i))).alias("end"),
            F.get(v, i).alias("value"),
            F.lower(F.right(F.get(g, i), F.lit(CONTEXT))).alias("before"),
            F.left(F.get(g, i + 1), F.lit(1)).alias("after"),
        )))[0]

    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    found = F.transform(
        F.array(F.struct(values.alias("v"), gaps.alias("g"))),
        lambda both: F.when(F.size(both["v"]) == 0, none).otherwise(placed(both)),
    )[0]
    return F.when(text.rlike(hint), found).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _sound(kind: str, value: Column) -> Column:
    """What a match must fulfil beyond its pattern."""
    digits = _digits(value)
    if kind == "ip":
        return value.rlike(rf"^{_octet}(?:\.{_octet}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _vote(up: Column, down: Column) -> Column:
    return F.when(down, F.lit(-1)).when(up, F.lit(1)).otherwise(F.lit(0))


def _votes(kind: str, m: Column, is_base: bool) -> Column:
    """One vote a labeler: pattern, gazetteer, context, surroundings, shape (1, 0 or -1)."""
    value, digits = m["value"], _digits(m["value"])
    plain = F.regexp_replace(value, r"\[\.\]", ".")
    known = (digits if kind == "card" else plain).rlike(GAZETTEER[kind])
    sound = _sound(kind, plain)
    glued = m["before"].rlike("[0-9a-z_#=\"]$") | m["after"].rlike("[0-9A-Za-z_\"]")
    shape = {
        "email": F.length(value).between(6, 80),
        "ip": ~plain.rlike(r"(?:^|\.)0[0-9]"),
        "card": F.length(digits).between(15, 16),
        "phone": F.length(digits).between(10, 13),
    }[kind]
    no = F.lit(False)
    return F.array(
        _vote(sound if is_base or kind == "card" else no, ~sound),
        _vote(known, ~known),
        _vote(m["before"].rlike(CUES[kind]), no),
        _vote(~glued, glued),
        _vote(shape, ~shape),
    )


def _features(kind: str, m: Column, votes: Column) -> Column:
    """Names of what the classifier sees: each vote, the characters around, the length."""
    sort = lambda c: F.when(c == "", "edge").when(c.rlike("[0-9]"), "digit").when(c.rlike(r"\s"), "space").when(c.rlike(r"\p{L}"), "letter").otherwise("other")
    named = [F.concat(F.lit(f"{kind} vote{i} "), F.get(votes, i).cast("string")) for i in range(LABELERS)]
    length = F.least(F.length(_digits(m["value"])), F.lit(20)).cast("string")
    around = [F.concat(F.lit(f"{kind} before "), sort(F.right(m["before"], F.lit(1)))), F.concat(F.lit(f"{kind} after "), sort(m["after"]))]
    return F.array(*named, *around, F.concat(F.lit(f"{kind} digits "), length))


def _candidates(text: Column) -> Column:
    """All candidates of a text: kind, place, whether a base pattern gives it, votes, features."""
    parts = []
    for number, kind in enumerate(KINDS):
        for is_base in (True, False):
            pattern, hint = (BASE[kind], BASE_HINT[kind]) if is_base else (WIDE[kind], WIDE_HINT[kind])

            parts.append(F.transform(_matches(text, pattern, hint), _described(number, is_base)))
    return F.concat(*parts)


def _described(number: int, is_base: bool):
    kind = KINDS[number]

    def described(m: Column) -> Column:
        return F.transform(F.array(_votes(kind, m, is_base)), lambda votes: F.struct(
            F.lit(number).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
            (F.lit(is_base) & _sound(kind, m["value"])).alias("base"),
            F.lit(not is_base).alias("wide"),
            votes.alias("votes"), _features(kind, m, votes).alias("features"),
        ))[0]

    return described


def reliabilities(patterns: list[tuple[int, tuple[int, ...], float]]) -> dict[tuple, float]:
    """Probability that a candidate with these votes is personal data, for each vote pattern.

    Expectation-maximisation per kind: each labeler has a distribution of votes for right and
    for wrong candidates; the start is a majority vote.
    """
    posterior: dict[tuple, float] = {}
    by_kind: dict[int, list] = defaultdict(list)
    for kind, votes, n in patterns:
        by_kind[kind].append((votes, n))
    for kind, rows in sorted(by_kind.items()):
        rows.sort()
        right = {votes: 1 / (1 + math.exp(-sum(votes))) for votes, _ in rows}
        for _ in range(ROUNDS):
            table = [[[1.0, 1.0, 1.0] for _ in range(LABELERS)] for _ in range(2)]
            mass = [1.0, 1.0]
            for votes, n in rows:
                for y, share in ((1, right[votes]), (0, 1 - right[votes])):
                    mass[y] += n * share
                    for j, vote in enumerate(votes):
                        table[y][j][vote + 1] += n * share
            for votes, _ in rows:
                odds = math.log(mass[1] / mass[0])
                for j, vote in enumerate(votes):
                    up, down = table[1][j], table[0][j]
                    odds += math.log(up[vote + 1] / sum(up)) - math.log(down[vote + 1] / sum(down))
                right[votes] = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
        posterior |= {(kind, votes): p for votes, p in right.items()}
    return posterior


def _lookup(values: dict[str, float], key: Column, default: float) -> Column:
    if not values:
        return F.lit(default)
    pairs = [F.lit(x) for pair in sorted(values.items()) for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def _pattern(c: Column) -> Column:
    return F.concat_ws(",", F.array(c["kind"]).cast("array<string>"), c["votes"].cast("array<string>"))


def train(found: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of the classifier's features and the prior of each kind, from all candidates.

    ``found`` has a column ``spans``. Each candidate counts as personal data by the share that
    its vote pattern has; features are weighed by how much more often they then occur.
    """
    each = found.select(F.explode("spans").alias("c")).select("c.*")
    counts = each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    posterior = reliabilities([(r.kind, tuple(r.votes), float(r.n)) for r in counts])
    shares = {",".join(map(str, (kind, *votes))): p for (kind, votes), p in posterior.items()}
    share = _lookup(shares, _pattern(F.struct("kind", "votes")), 0.5)
    sums = (
        each.select("kind", F.explode("features").alias("feature"), share.alias("p"))
        .groupBy("kind", "feature").agg(F.sum("p").alias("right"), F.sum(1 - F.col("p")).alias("wrong")).collect()
    )
    mass = {k: [1.0, 1.0] for k in range(len(KINDS))}
    for (kind, votes), p in posterior.items():
        n = next(r.n for r in counts if r.kind == kind and tuple(r.votes) == votes)
        mass[kind][1] += n * p
        mass[kind][0] += n * (1 - p)
    prior = {str(k): math.log(m[1] / m[0]) for k, m in mass.items()}
    weights = {r.feature: math.log((r.right + 1) / (mass[r.kind][1] + 2)) - math.log((r.wrong + 1) / (mass[r.kind][0] + 2)) for r in sums}
    return weights, prior


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``base``, ``added``, ``n_secret`` per row of ``docs``: arrays of (kind, start, end),
    and how many keys or passwords are given in the text.

    ``kind`` is the place in ``KINDS``; places are code points, the end exclusive. ``base``
    has the sound matches of the base patterns; ``added`` has matches of the wider patterns that
    the classifier takes for personal data and that no base span of their kind touches. Unsound
    matches of base patterns are examples for the labelers and never reported. Null and
    empty texts have none; repeated rows and ids keep a row each; other columns are not looked
    at. An empty table gives an empty result. Documents are read once and never shuffled.
    """
    text = F.coalesce(col(text_column).cast("string"), F.lit(""))
    found = docs.select(col(id_column).alias("doc_id"), _candidates(text).alias("spans"), F.regexp_count(text, F.lit(SECRET)).cast("long").alias("n_secret"))
    found = stored(found, "pii")
    weights, prior = train(found)

    def score(c: Column) -> Column:
        return F.aggregate(c["features"], _lookup(prior, c["kind"].cast("string"), 0.0), lambda acc, f: acc + _lookup(weights, f, 0.0))

    span = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    base = F.transform(F.filter("spans", lambda c: c["base"]), span)
    rows = found.select("doc_id", "n_secret", F.array_sort(base).alias("base"), F.filter("spans", lambda c: c["wide"]).alias("rest"))
    limit = math.log(threshold / (1 - threshold))
    touches = lambda c: F.exists("base", lambda b: (b["kind"] == c["kind"]) & (b["start"] < c["end"]) & (c["start"] < b["end"]))
    chosen = F.filter("rest", lambda c: (score(c) >= limit) & ~touches(c))
    added = F.when(F.size("rest") == 0, F.array().cast(rows.schema["base"].dataType)).otherwise(F.array_sort(F.array_distinct(F.transform(chosen, span))))
    # Of overlapping additions of a kind the first stays.
    first = F.filter("added", lambda c: ~F.exists("added", lambda b: (b["kind"] == c["kind"]) & (b["start"] < c["start"]) & (c["start"] < b["end"])))
    return rows.select("doc_id", "n_secret", "base", added.alias("added")).select("doc_id", "base", first.alias("added"), "n_secret")


def listed(spans: Column) -> Column:
    """kind:start:end by kind, then start, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; overlapping spans by the first."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    done = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.get(names, s["kind"]), F.lit("]")).alias("out"),
        )),
    )
    return F.transform(F.array(done), lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))[0]
