import base64
import glob
import gzip
import hashlib

import pytest

from leafledger.llm import warc
from leafledger.llm.shared import scratch

SCHEMA = "page_id long, url string, html string, path string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


ROWS = [(i, f"http://x/{i}", f"<p>{'z' * (i % 50)}{i % 7}</p>") for i in range(400)] + [
    (1000, "http://e/1", ""), (1001, "http://e/2", None), (1002, None, ""), (-5, "http://n\r\nInjected: 1", "négatif"),
    (7, "http://x/7", f"<p>{'z' * 7}0</p>"), (None, "http://null", "only here"), (None, "http://null2", "<p>0</p>"), (1 << 62, "big", "big"),
    (3000, "long", "w" * 300_000),
]


def brute(rows):
    last, used, out = {}, set(), []
    for page_id, _, html in rows:
        last.setdefault(html or "", []).append(page_id)
    for page_id, _, html in rows:
        data, ids = (html or "").encode(), last[html or ""]
        top = max((i for i in ids if i is not None), default=None)
        whole = page_id == top and (html or "", top) not in used
        if whole:
            used.add((html or "", top))
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if whole else "revisit",
                    None if whole else top))
    return sorted(out, key=str)


def read(spark, folder):
    return warc.read_archives(spark, folder)


@pytest.mark.parametrize("roll, shard", [(1 << 22, 1 << 24), (2000, 3000)])
def test_round_trip(spark, roll, shard):
    folder = scratch(spark, "t")
    manifest = warc.write_archives(pages(spark, ROWS), folder, roll, shard)
    rows = read(spark, folder).collect()
    assert all(r.digest_ok for r in rows)
    assert sorted((tuple(r)[:5] for r in rows), key=str) == brute(ROWS)
    names = sorted(glob.glob(folder.removeprefix("file://") + "/*.warc.gz"))
    assert [n.rsplit("/", 1)[1] for n in names] == sorted(r.name for r in manifest.collect())
    assert not glob.glob(folder.removeprefix("file://") + "/_temporary*")
    if roll == 2000:
        assert len(names) > 5
        assert all(m.bytes <= 2000 or m.records == 1 for m in manifest.collect())


def test_the_same_pages_give_the_same_bytes(spark):
    digests = []
    for n in (1, 3):
        folder = scratch(spark, "t")
        manifest = warc.write_archives(pages(spark, ROWS).repartition(n), folder, 3000, 9000)
        digests.append(sorted((r.name, r.records, r.bytes, r.sha256) for r in manifest.collect()))
    assert digests[0] == digests[1]


def test_standard_framing(spark):
    folder = scratch(spark, "t")
    warc.write_archives(pages(spark, ROWS[:3]), folder)
    data = b"".join(gzip.open(f).read() for f in sorted(glob.glob(folder.removeprefix("file://") + "/*.gz")))
    assert data.count(b"WARC/1.1\r\n") == 3 and data.endswith(b"\r\n\r\n")
    assert b"HTTP/1.1 200 OK" in data


def test_a_header_takes_no_line_breaks():
    assert b"\nInjected" not in warc.record(1, "a\r\nInjected: 1", b"", "D", None, False).split(b"\r\n\r\n")[0]


def test_files_of_lost_attempts_are_not_read(spark):
    folder = scratch(spark, "t")
    warc.write_archives(pages(spark, ROWS[:5]), folder)
    local = folder.removeprefix("file://")
    with open(f"{local}/_temporary-shard-00000001-00000.warc.gz-lost", "wb") as out:
        out.write(b"half a file")
    assert read(spark, folder).count() == 5
    with open(f"{local}/shard-99999999-00000.warc.gz", "wb") as out:
        out.write(b"not in the manifest")
    with pytest.raises(ValueError):
        read(spark, folder)


def test_no_pages(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


def jobs_of(spark, run):
    spark.sparkContext.setJobGroup(name := f"warc-{id(run)}", name)
    run()
    started = spark.sparkContext.statusTracker().getJobIdsForGroup(name)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(started)


def test_jobs_do_not_grow_with_the_shards(spark):
    few, many = (jobs_of(spark, lambda: warc.write_archives(pages(spark, ROWS), scratch(spark, "t"), 1 << 22, target)) for target in (200_000, 500))
    assert many <= few + 2


def test_a_damaged_record_raises(spark):
    folder = scratch(spark, "t")
    name = warc.write_archives(pages(spark, ROWS[:30]), folder).head().name
    path = f"{folder.removeprefix('file://')}/{name}"
    data = gzip.open(path).read()
    broken = data.replace(b"<p>zz", b"<p>zy", 1)
    assert broken != data
    members = b"".join(gzip.compress(b"WARC/1.1" + part, mtime=0) for part in broken.split(b"WARC/1.1")[1:])
    rows = spark.createDataFrame([(bytearray(members),)], "content binary")
    read_back = rows.mapInArrow(warc._read, warc._read_columns)
    assert [r.digest_ok for r in read_back.collect()].count(False) == 1
    with pytest.raises(Exception, match="damaged record"):
        warc.sound(read_back).collect()
