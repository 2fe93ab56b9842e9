import random

from pyspark.sql import functions as F

from leafledger.functions import paths as P
from leafledger.operators.paths import derive_entries
from leafledger.operators.profile import directory_count
from leafledger.operators.tree import render_tree, tree_order

NAMES = ["zoo", "Ant", "bee/hive/wax", "bee/comb", "cow/calf/hoof/nail"]
DRAWN = [
    "├── bee/", "│   ├── hive/", "│   │   └── wax", "│   └── comb", "├── cow/", "│   └── calf/", "│       └── hoof/",
    "│           └── nail", "├── Ant", "└── zoo",
]


def brute(files):
    """Draw from nested dictionaries."""
    root = {}
    for path in files:
        *folders, name = path.split("/")
        at = root
        for folder in folders:
            at = at.setdefault(folder, {})
        at[name] = None

    def draw(node, before):
        items = sorted(node.items(), key=lambda kv: (kv[1] is None, kv[0].encode()))
        for i, (name, below) in enumerate(items):
            last = i == len(items) - 1
            yield before + ("└── " if last else "├── ") + name + ("" if below is None else "/")
            if below is not None:
                yield from draw(below, before + ("    " if last else "│   "))

    return list(draw(root, ""))


def drawn(df):
    return [r.line for r in render_tree(df).orderBy("tree_key").collect()]


def test_known_tree(corpus):
    entries = derive_entries(corpus(dict.fromkeys(NAMES, "")))
    assert drawn(entries) == DRAWN == brute(NAMES)
    assert directory_count(entries).first()[0] == 6


def test_random_trees(corpus):
    rng = random.Random(2)
    names = ["a", "B", "é", "a-b", "a.b", "zz", "_", "~"]
    for _ in range(3):
        files = {f"{'/'.join(rng.choices(names, k=rng.randrange(1, 5)))}.{i}" for i in range(120)}
        entries = derive_entries(corpus(dict.fromkeys(files, "")))
        assert drawn(entries) == brute(files)
        order = tree_order(entries)
        by_position = [r.relpath for r in order.orderBy("position").collect()]
        assert by_position == [r.relpath for r in order.orderBy("tree_key").collect()]


def test_documents_are_scanned_at_most_twice(spark, sf_dir):
    from leafledger.sources import tables

    ordered = tree_order(derive_entries(tables.corpus(spark, sf_dir)))
    ordered.collect()
    plan = ordered._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") <= 2


def test_key_of_a_folder_precedes_its_files(spark):
    rows = spark.createDataFrame(
        [("a", True), ("a/z", False), ("a-b", True), ("a/b", True), ("a/b/c", False), ("0", False)],
        "relpath string, is_dir boolean")
    keyed = rows.orderBy(P.tree_key(F.col("relpath"), F.col("is_dir")))
    assert [r.relpath for r in keyed.collect()] == ["a", "a/b", "a/b/c", "a/z", "a-b", "0"]
