import random
import zlib

import pytest

from actionloom.llm import byte_shards
from actionloom.llm.prefix import prefix_sums
from tests.llm.helpers import ODD, docs, empty


def expected(rows, shards):
    sized = sorted(((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t, _ in rows))
    total, before, out, slots = sum(r[3] for r in sized), 0, [], {}
    for known, i, crc, size in sized:
        shard = min(shards - 1, (2 * before + size) * shards // (2 * total))
        out.append((i if known else None, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    return sorted(out, key=str)


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_against_a_plain_walk(spark, shards):
    r = random.Random(shards)
    rows = ODD + [(r.randrange(50), "é" * r.randrange(40), "en") for _ in range(500)] + [(77, "same", "en")] * 300
    got = byte_shards.shard_documents(docs(spark, rows), shards).collect()
    assert sorted([(x.doc_id, x["size"], x.text_crc32, x.shard, x.slot) for x in got], key=str) == expected(rows, shards)


def test_balance_and_order(spark):
    rows = [(i, "x" * (i * 37 % 900), "en") for i in range(4000)]
    got = byte_shards.shard_documents(docs(spark, rows)).collect()
    sizes, target = {}, sum(r["size"] for r in got) / 40
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
    assert set(sizes) == set(range(40)) and all(abs(s - target) <= 916 for s in sizes.values())
    shards = [r.shard for r in sorted(got, key=lambda r: r.doc_id)]
    assert shards == sorted(shards)


def test_same_result_however_stored(spark):
    rows = [(i % 90, "word " * (i % 13), "en") for i in range(400)]
    one = byte_shards.shard_documents(docs(spark, rows).coalesce(1)).collect()
    many = byte_shards.shard_documents(docs(spark, rows).repartition(9)).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_written_shards_hold_all_texts(spark, tmp_path):
    path = str(tmp_path / "shards")
    manifest = byte_shards.write_shards(docs(spark, ODD), path, shards=5)
    read = spark.read.parquet(path)
    assert sorted(map(str, ((r.doc_id, r.text) for r in read.collect()))) == sorted(map(str, ((i, t) for i, t, _ in ODD)))
    assert manifest.selectExpr("sum(documents)", "sum(bytes)").first()[0] == len(ODD)


def test_empty_and_null_sizes(spark):
    assert byte_shards.shard_documents(empty(spark)).count() == 0
    rows = spark.createDataFrame([(1, None), (2, 5), (3, 0), (3, 0)], "id long, s long")
    placed = prefix_sums(rows, ["id"], "s")
    assert (placed.count, placed.total) == (4, 5)
    assert sorted((r._row, r._before) for r in placed.rows.collect()) == [(0, 0), (1, 0), (2, 5), (3, 5)]
    assert {r.shard for r in byte_shards.assign(rows.filter("s = 0"), "s", ["id"]).collect()} == {0}
