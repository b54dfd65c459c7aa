import random

from pyspark.sql import functions as F

from lodestrata.plans.ranges import overlap_join


def test_overlap_join_is_the_plain_range_join(spark):
    rng = random.Random(3)
    make = lambda n: [(rng.randint(0, 2), a := rng.randint(0, 300), a + rng.choice([0, 1, 10, 150])) for _ in range(n)]
    a, b = make(60), make(60)
    x = spark.createDataFrame(a, "k int, lo int, hi int")
    y = spark.createDataFrame(b, "k int, start int, end int")
    found = sorted(map(tuple, overlap_join(x, y, ["k"], ("lo", "hi"), ("start", "end"), 16).select("k", "lo", "hi", "start", "end").collect()))
    assert found == sorted((k, p, q, s, e) for k, p, q in a for j, s, e in b if j == k and p <= e and q >= s)
    assert overlap_join(x.where(F.lit(False)), y, ["k"], ("lo", "hi"), ("start", "end")).count() == 0
