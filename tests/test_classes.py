"""Nothing is lost where blocks are large."""

from pyspark.sql import functions as F

from lectern.operators import resolution, signatures


def test_large_blocks_are_returned(spark):
    rows = spark.createDataFrame([(i, "a" if i < 21 else "b" if i < 41 else None, "t") for i in range(45)], "id long, block string, t string")
    pairs = resolution.blocked_pairs(rows, "id", F.col("block"), "t", lambda a, b: F.lit(1.0)).collect()
    large = [tuple(r) for r in resolution.large_blocks(rows, "id", F.col("block")).collect()]
    assert len(pairs) == 190 and sorted(large) == [(i, 0, 21) for i in range(21)]


def test_every_vector_of_a_class_is_returned(spark):
    one, near, far = [1.0] * 64, [1.0] * 63 + [-1.0], [-1.0] * 64
    rows = spark.createDataFrame([(1, one), (2, [2.0] * 64), (3, near), (4, far), (5, far), (6, None)], "id long, v array<double>")
    assert [r[0] for r in rows.where("id in (1, 3)").orderBy("id").select(signatures.sign_bits("v", 64)).collect()] == [-1, 2**63 - 1]
    got = [tuple(r) for r in signatures.hamming_members(rows, "id", signatures.sign_bits("v", 64)).collect()]
    assert sorted(got) == [(1, 1, 2, 1), (2, 1, 2, 1), (3, 3, 1, 1), (4, 4, 2, 0), (5, 4, 2, 0)]
