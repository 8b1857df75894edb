import random

from transcripta.functions import quantiles


def test_sketches_of_parts_merge_to_the_whole(spark):
    rng = random.Random(2)
    values = [(k % 10, k % 2, rng.expovariate(1)) for k in range(20_000)] + [(3, 0, None), (4, 5, None)]
    rows = spark.createDataFrame(values, "day int, key int, ms double")
    parts = quantiles.sketches(rows, ["day", "key"], "ms")
    whole = quantiles.merged(parts, ["key"])
    exact = {r.key: r for r in quantiles.percentiles(rows, ["key"], "ms", {"p50": 0.5, "p95": 0.95}).collect()}
    found = whole.select("key", "n", quantiles.quantile("sketch", 0.5).alias("p50"), quantiles.quantile("sketch", 0.95).alias("p95")).collect()
    assert {r.key for r in found} == {0, 1} and exact[5].p50 is None
    for r in found:
        own = sorted(v for _, k, v in values if k == r.key and v is not None)
        assert r.n == len(own) == exact[r.key].n
        for got, point in ((r.p50, 0.5), (r.p95, 0.95)):
            assert abs(sum(v <= got for v in own) / len(own) - point) < 0.03
            at = point * (len(own) - 1)
            assert abs(getattr(exact[r.key], f"p{round(100 * point)}") - (own[int(at)] + (at % 1) * (own[int(at) + 1] - own[int(at)]))) < 1e-9
