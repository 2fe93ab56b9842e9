from leafledger.operators import status as G

CODES = {
    "??": ("Untracked", False, False), "A ": ("Added", False, True), " M": ("Modified (not staged)", True, False),
    "M ": ("Modified (staged)", True, True), "MM": ("Modified (partially staged)", True, True),
    "D ": ("Deleted (staged)", True, True), " D": ("Deleted (not staged)", True, False),
    "R ": ("Renamed", True, True), "C ": ("Copied", False, True), "UU": ("Conflict", False, True),
    "XX": ("Unknown status", False, True),
}


def test_every_code(spark):
    tracked = spark.createDataFrame([(c,) for c in CODES] + [("same",)], "path string")
    status = spark.createDataFrame([(c, c) for c in CODES] + [("new", "??"), ("added", "M ")], "path string, xy string")
    rows = {r.path: r for r in G.file_status(tracked, status).collect()}
    for code, (text, modified, staged) in CODES.items():
        assert (rows[code].status, rows[code].modified, rows[code].staged, rows[code].tracked) == (
            text, modified, staged, True)
    assert (rows["same"].status_code, rows["same"].status) == ("", "Unchanged")
    assert (rows["new"].tracked, rows["new"].staged) == (False, False)
    assert (rows["added"].tracked, rows["added"].modified, rows["added"].staged) == (False, False, True)
    summary = G.status_summary(G.file_status(tracked, status)).first()
    assert tuple(summary) == (14, 12, 2, 6, 9)
    assert G.changed_files(G.file_status(tracked, status)).count() == 13


def test_porcelain(spark):
    lines = spark.createDataFrame([(" M a b.txt",), ("",), ("R  old -> new",), ("?? d/",)], "value string")
    assert [tuple(r) for r in G.parse_porcelain(lines).collect()] == [
        ("a b.txt", " M"), ("old -> new", "R "), ("d/", "??")]
