import zlib

from parcelight.llm import sharding as S


def placed(df):
    return [r.asDict() for r in S.assign_shards(df, pieces=4).collect()]


def test_sizes_slots_and_growth(corpus, texts):
    rows = placed(corpus)
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_even_and_moves_its_share(spark):
    from pyspark.sql import functions as F

    tree, n = S.SIXTEEN, 64_000
    got = spark.range(n).select(S.shard_of(F.col("id"), tree).alias("a"), S.shard_of(F.col("id"), S.grown(tree)).alias("b"))
    counts = [r["count"] for r in got.groupBy("a").count().collect()]
    assert len(counts) == 16 and max(counts) < 1.1 * n / 16
    moved = got.filter("a != b")
    assert moved.filter("b != 16").count() == 0
    assert abs(moved.count() - n / 17) < 0.1 * n / 17


def test_changed_weight_moves_only_into_its_subtree(spark):
    from pyspark.sql import functions as F

    a, b = S.cluster_tree([[[1, 1], [1, 1]], [[1, 1]]]), S.cluster_tree([[[1, 1], [1, 3]], [[1, 1]]])
    moved = spark.range(20_000).select(S.shard_of(F.col("id"), a).alias("a"), S.shard_of(F.col("id"), b).alias("b")).filter("a != b").distinct().collect()
    assert moved and all(r["b"] < 4 for r in moved)  # into the region that grew
    assert not any(r["a"] < 2 and r["b"] < 2 for r in moved)  # nothing moves within an unchanged rack


def test_odd_rows(make_docs):
    rows = placed(make_docs([None, "", "a", "a", "é" * 3], [1, None, 2, 2, None], shard=5, slot="x"))
    assert sorted(r["size"] for r in rows) == [1, 1, 2, 2, 7]
    assert placed(make_docs([])) == []
    same = [r for r in rows if r["doc_id"] == 2]
    assert same[0]["shard"] == same[1]["shard"] and same[0]["slot"] != same[1]["slot"]
