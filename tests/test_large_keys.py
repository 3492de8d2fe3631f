"""Keys of large tables: powers of a key do not leave the range of a long."""

import math

from roamlens.plans.names import listed_points
from roamlens.sources.adapters import Tables


def test_points_of_large_customer_keys(spark, tmp_path):
    keys = [0, 1, 14_999, 2_100_000, 5_399_999, 4_000_000_000, -7, None]
    spark.createDataFrame([(k, "n", "s") for k in keys], "c_custkey long, c_name string, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.place_id: (r.lat, r.lng, r.review_count) for r in listed_points(Tables(spark, str(tmp_path))).collect()}
    want = {k: (22 + math.fmod(k**2 * 37 % 3100, 3100) / 10000, 90 + math.copysign(abs(k) ** 3 % 2350, k) / 10000, int(math.copysign(abs(k) * 13 % 500, k)))
            for k in keys if k is not None}
    assert got == want | {None: (None, None, None)}
