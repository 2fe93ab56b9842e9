"""Language mixtures by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafledger.llm.shared import col, free_name

UNKNOWN = "und"
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: Bytes of text whose n-grams are held at once, each with some numbers per language.
SLICE = 1 << 18
#: The model has BUCKETS numbers a language; more languages than this are an error, not a cut.
MAX_LANGUAGES = 512
SMOOTHING = 0.5
MIX_ROUNDS = 8
SET_ROUNDS = 6
#: Each byte lies in three n-grams, so their likelihoods count the same evidence three times.
OVERLAP = 3.0
#: Least share of a further language that counts as one.
LEAST_SHARE = 0.02

_letter = regex.compile(r"\p{L}")
_blank = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def held_out(id_column: str = "doc_id"):
    """True for the fifth of the ids that nothing is learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _learnable(id_column: str, lang_column: str):
    fold = F.crc32(F.col(id_column).cast("string").cast("binary")) % 5
    return (fold != 0) & F.col(lang_column).isNotNull()


def _buckets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each three-byte gram, and which grams have a letter inside or at both ends."""
    left, middle, right = data[:-2], data[1:-1], data[2:]
    bucket = ((left << 16 | middle << 8 | right) * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    return bucket.astype(np.int64), (middle != 32) | ((left != 32) & (right != 32))


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of texts that fit a slice together: owner and bucket of each telling gram."""
    data = np.frombuffer(b"  ".join([b"", *texts, b""]), np.uint8).astype(np.uint32)
    if data.size < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bucket, telling = _buckets(data)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    return owner[telling], bucket[telling]


def _counts(text: bytes) -> np.ndarray:
    """How often each bucket occurs in one text of any length."""
    padded, found = b"  " + text + b"  ", np.zeros(BUCKETS, np.int64)
    for start in range(0, len(padded) - 2, SLICE):
        bucket, telling = _buckets(np.frombuffer(padded[start : start + SLICE + 2], np.uint8).astype(np.uint32))
        found += np.bincount(bucket[telling], minlength=BUCKETS)
    return found


def _prepared(text: str) -> bytes:
    return text.lower().encode(errors="replace").translate(_blank)


def _slices(texts: list[str | None]) -> Iterator[list[int]]:
    """Indices of texts, as many as fill a slice; a longer text is alone."""
    part, size = [], 0
    for i, text in enumerate(texts):
        if part and size + len(text or "") > SLICE:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(text or "")
    if part:
        yield part


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column(0), batch.column(1).to_pylist()
        for part in _slices([t.as_py() for t in texts]):
            by_lang: dict[str, list[bytes]] = {}
            for i in part:
                by_lang.setdefault(langs[i], []).append(_prepared(texts[i].as_py() or ""))
            for lang, own in by_lang.items():
                found = _counts(own[0]) if len(own) == 1 else np.bincount(_grams(own)[1], minlength=BUCKETS)
                counts[lang] = counts.get(lang, 0) + found
    for lang, found in counts.items():
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * used.size, pa.string()), pa.array(used.astype(np.int32)), pa.array(found[used])],
            ["lang", "bucket", "n"],
        )


class Model:
    """Languages in order of name and the probability of each n-gram bucket in them."""

    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        self.langs = langs
        smooth = counts + SMOOTHING
        self.p = (smooth / smooth.sum(axis=0, keepdims=True)) if langs else smooth


def train(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> Model:
    """Counts n-grams per language over all given rows; only the summed counts reach the driver.

    Their number is at most ``BUCKETS`` a language, and more than ``MAX_LANGUAGES`` languages
    raise an error, so what is broadcast later has a bound.
    """
    labelled = docs.select(F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"))
    labelled = labelled.where("text is not null and lang is not null")
    parts = labelled.mapInArrow(_count, "lang string, bucket int, n long")
    sums = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    per_lang = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("grams"))
    rows = per_lang.limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows.sort(key=lambda r: r.lang)
    counts = np.zeros((BUCKETS, len(rows)))
    for j, row in enumerate(rows):
        counts[[g.bucket for g in row.grams], j] = [g.n for g in row.grams]
    return Model([r.lang for r in rows], counts)


def _mix(p, c, doc, starts, total, share, rounds):
    """Rounds of expectation-maximisation of each document's language shares."""
    for _ in range(rounds):
        part = share[doc] * p
        part *= (c / part.sum(axis=1))[:, None]
        share = np.add.reduceat(part, starts) / total[:, None]
    return share


def _likelihood(p, c, doc, starts, share):
    return np.add.reduceat(c * np.log((share[doc] * p).sum(axis=1)), starts)


def shares(texts: list[bytes], model: Model) -> np.ndarray:
    """Language shares of prepared texts, zero outside the chosen set; rows of zeros have no gram.

    The set grows by the language with the next largest share in the mixture of all, as long
    as the penalised likelihood rises: a language must gain half the logarithm of the number
    of n-grams, in likelihood that is counted once per byte.
    """
    k = len(model.langs)
    out = np.zeros((len(texts), k))
    keys, weights = [], []
    for i, text in enumerate(texts):
        if len(text) <= SLICE:
            continue
        found = _counts(text)
        used = np.flatnonzero(found)
        keys.append(i * BUCKETS + used)
        weights.append(found[used])
    owner, bucket = _grams([t if len(t) <= SLICE else b"" for t in texts])
    key, n = np.unique(owner * BUCKETS + bucket, return_counts=True)
    if keys:
        key, n = np.concatenate([key, *keys]), np.concatenate([n, *weights])
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
    if not key.size or not k:
        return out
    owner, bucket, c = key >> BUCKET_BITS, key & (BUCKETS - 1), n.astype(float)
    new = np.r_[True, owner[1:] != owner[:-1]]
    starts, doc = np.flatnonzero(new), np.cumsum(new) - 1
    present = owner[starts]
    p, total = model.p[bucket], np.add.reduceat(c, starts)
    alone = np.add.reduceat(c[:, None] * np.log(p), starts)
    first = alone.argmax(axis=1)
    mixed = _mix(p, c, doc, starts, total, np.full((present.size, k), 1 / k), MIX_ROUNDS)
    best = np.eye(k)[first]
    best_score = alone.max(axis=1)
    penalty = OVERLAP * 0.5 * np.log(total + 1)
    open_ = _likelihood(p, c, doc, starts, mixed) - best_score > penalty
    rank = mixed.copy()
    rank[np.arange(present.size), first] = np.inf
    order = np.argsort(-rank, axis=1, kind="stable")
    for size in range(2, k + 1):
        docs = np.flatnonzero(open_)
        if not docs.size:
            break
        rows = np.flatnonzero(open_[doc])
        place = np.cumsum(open_) - 1
        sub_doc, sub_c = place[doc[rows]], c[rows]
        sub_starts = np.flatnonzero(np.r_[True, sub_doc[1:] != sub_doc[:-1]])
        chosen = order[docs, :size]
        sub_p = np.take_along_axis(p[rows], chosen[sub_doc], axis=1)
        fit = _mix(sub_p, sub_c, sub_doc, sub_starts, total[docs], np.full((docs.size, size), 1 / size), SET_ROUNDS)
        score = _likelihood(sub_p, sub_c, sub_doc, sub_starts, fit)
        better = (score - best_score[docs] > penalty[docs]) & (fit.min(axis=1) >= LEAST_SHARE)
        best_score[docs[better]] = score[better]
        best[docs[better]] = 0
        np.put_along_axis(grown := np.zeros((docs.size, k)), chosen, fit, axis=1)
        best[docs[better]] = grown[better]
        open_[docs[~better]] = False
    out[present] = best
    return out


def _judged(texts: list[str], model: Model) -> tuple[list[str], list[float], list[str]]:
    """Of each text its language, that one's share and all shares."""
    langs, scores, every = [], [], []
    for part in _slices(texts):
        raw = [texts[i] or "" for i in part]
        for text, row in zip(raw, shares([_prepared(t) for t in raw], model)):
            if not row.any() or not _letter.search(text):
                langs.append(UNKNOWN), scores.append(0.0), every.append("")
                continue
            order = np.argsort(-row, kind="stable")
            langs.append(model.langs[order[0]])
            scores.append(min(1.0, float(row[order[0]])))
            every.append(",".join(f"{model.langs[j]}:{row[j]:.4f}" for j in order if row[j]))
    return langs, scores, every


def predict(
    docs: DataFrame, model: Model, text_column: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "languages")
) -> DataFrame:
    """``docs`` with the predicted language, its share and all shares, without a shuffle.

    A text that is null or has no letter, or any text where nothing was learned, is ``und``
    with score 0. Equal likelihoods go to the language that is first by name. Only texts go to
    Python, and only these three come back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ("lang", "score", "languages")

    @F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType() if n == "score" else T.StringType()) for n in fields]))
    def judge(texts: pa.Array) -> pa.Array:
        found = _judged(texts.to_pylist(), shared.value)
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(found, (pa.string(), pa.float64(), pa.string()))], list(fields))

    added = [free_name(docs.columns, n) for n in names]
    held = free_name([*docs.columns, *added], "__found")
    found = docs.withColumn(held, judge(col(text_column).cast("string")))
    return found.select(*map(col, docs.columns), *[F.col(f"{held}.{f}").alias(n) for f, n in zip(fields, added)])


def identify(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``languages`` per row of ``docs``.

    Learns from the text of rows with a language whose id is not held out; only text decides a
    prediction. Null ids are not learned from and not held out. Other columns are not looked at.
    """
    model = train(docs.where(_learnable(id_column, "lang")))
    narrow = docs.select(F.col(id_column).alias("doc_id"), held_out(id_column).alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(narrow, model).drop("text")


def keep_identified(docs: DataFrame, least_score: float = 0.25, id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with a language that has at least ``least_score`` of the text."""
    model = train(docs.where(_learnable(id_column, "lang")))
    names = tuple(free_name(docs.columns, n) for n in ("__lang_pred", "__score", "__languages"))
    known = predict(docs, model, names=names)
    return known.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least_score)).select(*docs.columns)
