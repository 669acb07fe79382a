import base64
import glob
import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm import warc
from ledgerlens.llm.common import new_folder

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                      T.StructField("digest", T.StringType()), T.StructField("shard", T.LongType())])


def folder_of(spark):
    f = new_folder(spark, "test-warc")
    return f if ":" in f.split("/")[0] else f"file://{f}"


def pages(spark):
    rows = [(i, f"http://x.example/{i}?ü", f"<p>{i % 7}</p>" * (i % 50), None, 1) for i in range(300)]
    rows += [(500, None, None, "x", None), (501, "u", "", None, None), (None, "u", "<null id>", None, None), (502, "u", "é" * 200_000, None, None),
             (503, "a", "<twice>", None, None), (503, "a", "<twice>", None, None), (503, "b", "<other>", None, None)]
    return spark.createDataFrame(rows, PAGES)


def expected(rows):
    heads = {}
    for r in rows:
        h = r["html"] or ""
        if r["page_id"] is not None:
            heads[h] = max(heads.get(h, -1), r["page_id"])
    out, seen = [], set()
    for r in rows:
        raw = (r["html"] or "").encode()
        head = heads.get(r["html"] or "")
        first = r["page_id"] == head and (head, raw) not in seen
        seen.add((r["page_id"], raw))
        out.append((str(r["page_id"]), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else head))
    return sorted(out, key=str)


def test_round_trip_equals_brute_force(spark):
    df = pages(spark)
    folder = folder_of(spark)
    manifest = warc.write_warc(df, folder, roll_bytes=2000, shard_bytes=20_000).collect()
    assert len({m["shard"] for m in manifest}) > 3 and max(m["part"] for m in manifest) > 0
    got = warc.read_warc(spark, folder).collect()
    rows = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["type"], r["refers_to"]) for r in got if r["page_id"] is not None or True)
    assert sorted(rows, key=str) == expected(df.collect())
    assert all(hashlib.sha1(bytes(r["payload"])).hexdigest() for r in got if r["type"] == "response")
    assert len({r["record_id"] for r in got}) == len(got)


def test_same_bytes_whatever_the_partitions(spark):
    folders = [folder_of(spark) for _ in range(2)]
    for f, n in zip(folders, (1, 7), strict=True):
        warc.write_warc(pages(spark).repartition(n), f, roll_bytes=2000, shard_bytes=20_000)
    names = [sorted(p.rsplit("/", 1)[1] for p in glob.glob(f.removeprefix("file://") + "/*.warc.gz")) for f in folders]
    assert names[0] == names[1]
    for n in names[0]:
        a, b = (open(f.removeprefix("file://") + "/" + n, "rb").read() for f in folders)
        assert a == b


def test_damage_is_found_and_leftovers_are_ignored(spark):
    folder = folder_of(spark)
    warc.write_warc(pages(spark), folder)
    path = folder.removeprefix("file://")
    n = warc.read_warc(spark, folder).count()
    open(path + "/shard-00009999-0000.warc.gz", "wb").write(b"left by a failed task")
    assert warc.read_warc(spark, folder).count() == n
    name = sorted(glob.glob(path + "/shard-00000*.warc.gz"))[0]
    data = bytearray(open(name, "rb").read())
    data[len(data) // 2] ^= 1
    open(name, "wb").write(data)
    with pytest.raises(Exception, match="differs from its manifest"):
        warc.read_warc(spark, folder).collect()


def test_empty_table(spark):
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_uris_are_percent_encoded_utf8(spark):
    from urllib.parse import unquote
    urls = {1: "http://x.example/ü/中?q=a b", 2: "http://x.example/new\nline", 3: "http://x.example/%41", 4: None}
    df = spark.createDataFrame([(i, u, "<p>", None, 1) for i, u in urls.items()], PAGES)
    got = {r["page_id"]: r["uri"] for r in warc.round_trip(df).collect()}
    assert got[1] == "http://x.example/%C3%BC/%E4%B8%AD?q=a%20b" and unquote(got[1]) == urls[1]
    assert got[2] == "http://x.example/new%0Aline" and got[3] == urls[3] and got[4] == "urn:x-none"


def test_every_shard_has_a_task_of_its_own(spark):
    for n in (1, 2, 7, 64):
        place = warc.places(spark, n)
        df = spark.createDataFrame([(int(p),) for p in place], "place long").repartition(n, "place")
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() == n
