"""Document tables seen as corpora.

Paths and times are derived from the keys, so any table with a key, a source
and a text can be profiled like a directory of files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafledger.operators.blocks import line_blocks
from leafledger.session import shared_dir

#: Minutes from 2024-03-01 back to the earliest time that a timestamp can be reckoned to, and one more.
#: Squares of ids from 392,076 on reach further back and start again from that day.
AGES = 153_722_867_281

CORPUS = f"""
    doc_id,
    source || '/' || lang || '/' || (CASE WHEN doc_id % 41 = 0 THEN '.' ELSE '' END)
      || 'doc_' || CAST(doc_id AS STRING)
      || CASE doc_id % 10
           WHEN 0 THEN '.md'   WHEN 1 THEN '.txt'  WHEN 2 THEN '.go'
           WHEN 3 THEN '.py'   WHEN 4 THEN '.json' WHEN 5 THEN '.html'
           WHEN 6 THEN '.PY'   WHEN 7 THEN ''      WHEN 8 THEN '.tar.gz'
           ELSE '.log' END AS relpath,
    CAST(octet_length(text) AS BIGINT) AS size_bytes,
    timestampadd(MINUTE, -CAST(CAST(doc_id AS DECIMAL(19)) * doc_id % {AGES} AS BIGINT), TIMESTAMP_NTZ '2024-03-01 00:00:00') AS mtime,
    source, lang, text
"""

PROJECTS = """
    CASE WHEN doc_id % 25 = 24 THEN '' ELSE 'p' || CAST(doc_id DIV 25 AS STRING) || '/' END || CASE
        WHEN doc_id % 25 = 24                    THEN 'README-' || CAST(doc_id AS STRING) || '.md'
        WHEN doc_id % 25 = 0 AND lang <> 'fr'    THEN 'README.md'
        WHEN doc_id % 25 = 1 AND n_chars % 2 = 0 THEN 'LICENSE'
        WHEN doc_id % 25 = 2 AND n_chars % 3 = 0 THEN '.gitignore'
        WHEN doc_id % 25 = 3 AND n_chars % 2 = 1 THEN 'tests/t.py'
        WHEN doc_id % 25 = 4                     THEN 'sub/README.md'
        WHEN doc_id % 25 = 5 AND n_chars % 5 = 0 THEN 'src/x_test.go'
        ELSE 'src/doc_' || CAST(doc_id AS STRING) || '.txt' END AS relpath,
    CAST(octet_length(text) AS BIGINT) AS size_bytes,
    text
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files ``source/lang/doc_N.ext``."""
    return spark.sql(f"SELECT {CORPUS} FROM {{docs}}", docs=table(spark, sf_dir, "documents"))


def project_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as projects of 24 files each, and files beside the projects."""
    return spark.sql(f"SELECT {PROJECTS} FROM {{docs}}", docs=table(spark, sf_dir, "documents"))


def page_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as HTML files; blanks become newlines, so comments span lines.

    Several addresses can name one path, so the page number is part of the name.
    """
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    stem = F.regexp_replace(F.regexp_replace(bare, "/$", "/index"), "\\.html$", "")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(stem, F.lit("-"), F.col("page_id").cast("string"), F.lit(".html")).alias("relpath"),
        F.octet_length("html").cast("long").alias("size_bytes"),
        F.replace("html", F.lit(" "), F.lit("\n")).alias("text"),
    )


RULE_LINES = """
    d.source || '/.gitignore' AS relpath,
    CAST(d.doc_id AS INT) AS line_no,
    CASE d.doc_id % 9
      WHEN 0 THEN '# note ' || CAST(d.doc_id AS STRING)
      WHEN 1 THEN 'doc_' || CAST(d.doc_id AS STRING) || '.txt'
      WHEN 2 THEN '*_' || CAST(d.doc_id % 1000 AS STRING) || '.*'
      WHEN 3 THEN '!doc_' || CAST(d.doc_id DIV 10 AS STRING) || '*'
      WHEN 4 THEN d.lang || '/doc_' || CAST(d.doc_id + 1 AS STRING) || '.*'
      WHEN 5 THEN '  ' || d.lang || '/ '
      WHEN 6 THEN '*' || CAST(d.doc_id % 100 AS STRING) || '.log'
      WHEN 7 THEN 'doc_' || CAST(d.doc_id % 100 AS STRING) || '?.*'
      ELSE '' END AS line
"""

SCOPED_RULE_LINES = """
    CASE d.doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN d.source || '/' ELSE d.source || '/' || d.lang || '/' END
      || '.gitignore' AS relpath,
    CAST(d.doc_id AS INT) AS line_no,
    CASE d.doc_id % 7
      WHEN 0 THEN 'doc_' || CAST(d.doc_id AS STRING) || '.*'
      WHEN 1 THEN '*c_' || CAST(d.doc_id % 100 AS STRING) || '*'
      WHEN 2 THEN '!*_' || CAST(d.doc_id % 50 AS STRING) || '?.*'
      WHEN 3 THEN d.lang || '/doc_' || CAST(d.doc_id % 300 AS STRING) || '*'
      WHEN 4 THEN '!doc_' || CAST(d.doc_id DIV 3 AS STRING) || '*'
      WHEN 5 THEN d.lang || '/'
      ELSE '!' || d.lang END AS line
"""

SNIFFED = """
    relpath, size_bytes,
    CASE doc_id % 7
      WHEN 0 THEN regexp_replace(text, '[aeiou ]', chr(1))
      WHEN 1 THEN replace(text, '. ', '.' || chr(0))
      WHEN 2 THEN ''
      ELSE text END AS text
"""

STATUS_CODES = "array('??', 'A ', ' M', 'M ', 'MM', 'D ', ' D', 'R ', 'C ', 'UU')"


def rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one ignore file per source, a line for each labelled document."""
    return spark.sql(
        f"SELECT {RULE_LINES} FROM {{docs}} d JOIN {{labels}} l ON d.doc_id = l.doc_id",
        docs=table(spark, sf_dir, "documents"),
        labels=table(spark, sf_dir, "labels"),
    )


def scoped_rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ignore files at the root, in sources and in their languages."""
    return spark.sql(
        f"SELECT {SCOPED_RULE_LINES} FROM {{docs}} d JOIN {{labels}} l ON d.doc_id = l.doc_id",
        docs=table(spark, sf_dir, "documents"),
        labels=table(spark, sf_dir, "labels"),
    )


def sniff_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with control characters, NULs and empty files in places."""
    return spark.sql(f"SELECT {SNIFFED} FROM {{files}}", files=corpus(spark, sf_dir))


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return corpus(spark, sf_dir).join(labels, "doc_id", "left_semi").select(
        F.col("relpath").alias("path")
    )


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code for the low-quality labelled documents and for some new paths."""
    return spark.sql(
        f"""
        SELECT CASE WHEN l.doc_id IS NULL THEN 'new/' ELSE '' END || c.relpath AS path,
               {STATUS_CODES}[CAST(c.doc_id % 10 AS INT)] AS xy
        FROM {{files}} c LEFT JOIN {{labels}} l ON c.doc_id = l.doc_id
        WHERE l.quality = 0 OR (l.doc_id IS NULL AND c.doc_id % 17 = 0)
        """,
        files=corpus(spark, sf_dir),
        labels=table(spark, sf_dir, "labels"),
    )


def with_empty_directories(entries: DataFrame) -> DataFrame:
    """Each directory gains an empty one below it, as a listing would show it."""
    made = entries.where("is_dir").selectExpr(
        "relpath || '/empty' AS relpath", "relpath AS parent", "'empty' AS name",
        "depth + 1 AS depth", "true AS is_dir",
    )
    return entries.unionByName(made)


def page_blocks(spark: SparkSession, sf_dir: str, lines_per_block: int = 16) -> DataFrame:
    """All pages as three files, each page many blocks of lines: comments cross blocks."""
    cut = line_blocks(page_corpus(spark, sf_dir).select(F.col("page_id").cast("string").alias("relpath"), "text"), lines_per_block)
    page = F.col("relpath").cast("long")
    return cut.select(
        F.concat(F.lit("site-"), (page % 3).cast("string"), F.lit(".html")).alias("relpath"),
        (page * (1 << 24) + F.col("block_no")).alias("block_no"), "text",
    )


def text_folders(spark: SparkSession, sf_dir: str) -> str:
    """``documents`` written as text files, one per source and thousand ids, below a new shared folder."""
    root = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    folder = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 1000).cast("string"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", folder.alias("folder"))
    rows.repartition("folder").sortWithinPartitions("folder", "doc_id").select("text", "folder").write.partitionBy("folder").text(root)
    return root
