import struct

import numpy as np
from pyspark.sql import functions as F

from fairloom.functions.ordered import from_ordered_long, with_ordered_long


def test_bits_of_all_kinds_of_doubles(spark):
    rng = np.random.default_rng(1)
    xs = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 20000).view(np.float64), rng.random(20000)])
    edge = [0.0, float("inf"), 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308]
    for e in range(-1022, 1023, 7):
        p = 2.0**e
        edge += [p, np.nextafter(p, 0), np.nextafter(p, np.inf), p * (1 - 2**-51)]
    xs = np.concatenate([xs[~np.isnan(xs)], edge, -np.array(edge)])
    df = spark.createDataFrame([(float(x),) for x in xs] + [(None,), (float("nan"),)], "x double")
    got = with_ordered_long(df, "x", "k").select("x", "k", from_ordered_long(F.col("k")).alias("y")).collect()
    assert len(got) == len(xs)
    for r in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(r.x)))[0]
        assert r.k == (-bits if r.x < 0 else bits), r
        assert r.y == r.x
