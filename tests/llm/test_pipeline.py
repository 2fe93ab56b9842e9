import hashlib
import random

import compare
import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafledger.llm import bpe, langid, mixing, queries, shared
from leafledger.llm.shared import table
from llm_brute import lines_removed, simhash_kept

PATH = public_tokenizers.path(corpus_pipeline.VOCABULARY)


def test_stages_against_plain_python(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    known = {r.doc_id: r for r in langid.identify(documents).collect()}
    rows = {r.doc_id: r.asDict() for r in documents.collect()}
    rows = {i: r for i, r in rows.items() if known[i].lang_pred != "und" and known[i].score >= corpus_pipeline.LEAST_SHARE}
    texts = lines_removed({i: r["text"] for i, r in rows.items()})
    kept = simhash_kept(texts)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == kept
    for i, r in got.items():
        assert r.ids == bpe._encoding(PATH, public_tokenizers.PATTERN).encode_ordinary(texts[i])
        assert (r.lang, r.source, r.n_tokens) == (rows[i]["lang"], rows[i]["source"], len(r.ids))
        assert r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(30).withColumn("slot", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns, name
        assert stage(spark, docs.where("doc_id < 0"), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_result_follows_the_mixture(make, spark, tmp_path):
    rng = random.Random(4)
    weights = {"src0": 6, "src1": 4, "src2": 3, "other": 2}
    sources = [s for s, k in weights.items() for _ in range(8 * k)]
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(words, k=6000 if i == 50 else 500)), "en", s) for i, s in enumerate(sources)]
    make(rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [r.position for r in got] == list(range(len(rows)))
    placed = mixing.mix(make(rows), corpus_pipeline.TARGET_WEIGHTS, corpus_pipeline.DEFAULT_WEIGHT).collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in sorted(placed, key=lambda r: (r.slot, r.place))]
    size = {i: len(text) for i, text, _, _ in rows}
    total, done = {s: sum(size[i] for i, t in enumerate(sources) if t == s) for s in weights}, dict.fromkeys(weights, 0)
    for r in got:
        done[r.source] += size[r.doc_id]
        if any(done[s] == total[s] for s in weights):
            break
        shares = [done[s] / k for s, k in weights.items()]
        assert max(shares) - min(shares) <= (2 * mixing.BLOCK_CHARS + max(size.values())) / min(weights.values())
    assert sum(done.values()) > 0.5 * sum(total.values())


def test_positions_follow_the_numbers_of_files(spark):
    names = ["d/part-100000-x.c000.parquet", "d/part-99999-x.c000.parquet", "d/part-00002-x.c001.parquet", "d/part-00002-x.c000.parquet"]
    rows = [(f, i) for f in names for i in range(3)]
    docs = spark.createDataFrame(rows, "f string, i long")
    got = shared.in_order_of_files(docs.selectExpr("*", "f AS f0", "i AS i0"), ("f", "i"), "p").collect()
    assert [(r.f0, r.i0, r.p) for r in got] == [(f, i, 3 * n + i) for n, f in enumerate(reversed(names)) for i in range(3)]

    unread = shared.placed(spark.range(20, numPartitions=3), ["id"], ("f", "i"))
    assert [(r.id, r.p) for r in shared.in_order_of_files(unread, ("f", "i"), "p").collect()] == [(i, i) for i in range(20)]


def test_language_stage_rejects_only_texts_without_letters(make, spark):
    stock = {"en": "the house of the man and a dog", "de": "das haus und der hund mit dem mann", "fr": "la maison et le chien de cet homme", "es": "la casa y el perro de un hombre"}
    rows = [(4 * i + j, f"{text} {i}", lang) for i in range(20) for j, (lang, text) in enumerate(stock.items())]
    rows += [(100, "1234 -- 5678 !!", "en"), (101, "zxqj wkvv qqzx jjxw zzkq", "en"), (102, " ".join(stock.values()), "en")]
    kept = {r.doc_id for r in corpus_pipeline.language(spark, make(rows), "").collect()}
    assert kept == {r[0] for r in rows} - {100}


def test_stages_bear_odd_rows(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.stored(stage(spark, docs, ""), name)
    assert docs.count() > 3


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_sql(spark, sf_dir, name):
    ours = compare.spark_rows(queries.QUERIES[name](spark, sf_dir))
    theirs = compare.duck_rows(compare.connect(sf_dir), queries.ORACLE_SQL[name])
    assert compare.differences(ours, theirs) is None


def test_every_number_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
