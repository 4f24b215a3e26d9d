import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from catalog.compare import duck_rows, spark_rows
from tarnish.llm import queries, sql, warc

DDL = "page_id long, url string, html string, SHARD int, kind string"


def rows_of(spark, folder, payloads=True):
    return sorted(map(tuple, warc.read(spark, folder, payloads).collect()), key=str)


def files_of(folder):
    path = folder.removeprefix("file://")
    return {f: hashlib.sha256(open(f"{path}/{f}", "rb").read()).hexdigest() for f in os.listdir(path) if f.endswith(".gz")}


def test_round_trip_and_edge_rows(spark):
    rows = [(5, "http://a/ b\n", "same", 1, "x"), (9, "http://b/", "same", 1, "x"), (7, None, "same", 1, None), (1, "u", None, 0, ""), (2, "u", "", 0, ""),
            (None, "n", "same", 0, ""), (3, "http://x", "é😀" * 1000, 0, ""), (3, "http://x", "other", 0, ""), (4, "r", "twice", 0, ""), (4, "r", "twice", 0, ""),
            (6, "l", "long " * 400000, 0, "")]
    pages = spark.createDataFrame(rows, DDL).repartition(3)
    folder = warc.new_folder(spark)
    manifest = warc.write(pages, folder, shard_bytes=1000, file_bytes=400)
    assert manifest.count() == len(files_of(folder)) > 3
    got = rows_of(spark, folder)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r)
    assert by[9][0][2:4] == ("response", None) and by[5][0][2:4] == by[7][0][2:4] == by[None][0][2:4] == ("revisit", 9)
    assert by[2][0][2:4] == ("response", None) and by[1][0][2:4] == ("revisit", 2)
    assert sorted((r[2], r[3] or 0) for r in by[4]) == [("response", 0), ("revisit", 4)]
    assert by[7][0][1] is None and by[5][0][1] == "http://a/%20b%0A"
    assert {r[6] for r in by[3]} == {("é😀" * 1000).encode(), b"other"} and by[6][0][6] == b"long " * 400000
    again = warc.new_folder(spark)
    warc.write(pages.repartition(7), again, shard_bytes=1000, file_bytes=400)
    assert files_of(again) == files_of(folder)
    for name in files_of(folder):
        assert gzip.open(f"{folder.removeprefix('file://')}/{name}").read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


ONE_KEY = {"none": None, "one": 77}


@pytest.mark.parametrize("case", ["outlier", "ends", "clusters", "none", "one"])
def test_no_shard_holds_much_more_than_its_share(spark, case):
    """An id far away, the ends of the range, dense clusters; a third of the rows without an id, or with the same."""
    ids = list(range(250))
    ids += {"outlier": [2**60], "ends": [-2**63, 2**63 - 1], "clusters": [k * 10**15 + i for k in range(5) for i in range(50)]}.get(case, [])
    ids += [ONE_KEY.get(case)] * 120 if case in ONE_KEY else []
    pages = spark.createDataFrame([(x, "u", f"{i:04d}" * 250) for i, x in enumerate(ids)], "page_id long, url string, html string").repartition(4)
    folder = warc.new_folder(spark)
    manifest = warc.write(pages, folder, shard_bytes=15_000, file_bytes=300).collect()
    shards = {}
    for r in manifest:
        shards[r.name[:11]] = shards.get(r.name[:11], 0) + r.records
    assert len(shards) >= len(ids) / 15 and max(shards.values()) <= 25
    assert len(manifest) > 2 * len(shards)  # files roll
    got = rows_of(spark, folder, False)
    assert sorted((r[0] for r in got), key=str) == sorted(ids, key=str) and {r[2] for r in got} == {"response"}


def test_shards_ascend_with_ids(spark):
    keyed = spark.createDataFrame([(x, f"{x:040d}", 1000) for x in [-2**63, -5, *range(300), 10**12, 2**63 - 1]], "page_id long, sha string, n long")
    shard, count = warc._shards(keyed, 15_000)
    got = [r.s for r in keyed.select("page_id", shard(F.col("page_id"), F.col("sha")).alias("s")).orderBy("page_id").collect()]
    assert got == sorted(got) and set(got) == set(range(count))


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "long one"), (4, "d", "long one")], "page_id long, url string, html string")
    folder = warc.new_folder(spark)
    warc.write(pages, folder, revisit_bytes=2)
    assert [(r[0], r[2], r[3]) for r in rows_of(spark, folder, False)] == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]


def test_empty_table(spark):
    folder = warc.new_folder(spark)
    assert warc.write(spark.createDataFrame([], DDL), folder).count() == 0
    assert warc.read(spark, folder).count() == 0


def test_damage_is_noticed():
    data = warc.record(1, "u", b"payload", None)
    assert warc.parse(data)[0] == 1
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"payload", b"pAyload"))


def test_matches_sql(spark, folder):
    assert spark_rows(queries.op10_warc(spark, folder)) == duck_rows(folder, sql.WARC)
