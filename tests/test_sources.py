import math

import pytest
from pyspark.sql import functions as F

from rillcount.functions.hashing import coefficients, string_id, uniform
from rillcount.sources import synthetic, trace
from rillcount.sources.reports import read_report, saved_sweep, write_report


def write(path, text):
    path.write_text(text)
    return str(path)


def pairs(df):
    return sorted((r.item, r.weight) for r in df.collect())


def test_trace_stops_at_the_first_bad_line(spark, tmp_path):
    path = write(tmp_path / "t.txt", "5 10\n\n 6\t20 \n7 x\n8 30\n")
    assert pairs(trace.read_weighted_trace(spark, path, stop_at_bad=True)) == [(5, 10), (6, 20)]
    assert pairs(trace.read_weighted_trace(spark, path)) == [(5, 10), (6, 20), (8, 30)]
    assert [r.line for r in trace.rejected_lines(spark, path).collect()] == ["7 x"]


@pytest.mark.parametrize("bad", ["7 0", "7 -1", "7", "7 1 2"])
def test_trace_refuses_what_is_not_an_update(spark, tmp_path, bad):
    path = write(tmp_path / "t.txt", f"5 10\n{bad}\n8 30\n")
    assert pairs(trace.read_weighted_trace(spark, path, stop_at_bad=True)) == [(5, 10)]
    assert pairs(trace.read_weighted_trace(spark, path)) == [(5, 10), (8, 30)]


def test_trace_cap_is_a_prefix(spark, tmp_path):
    path = write(tmp_path / "t.txt", "1 4\n2 4\n3 10\n4 1\n")
    assert pairs(trace.read_weighted_trace(spark, path, cap=19)) == [(1, 4), (2, 4), (3, 10)]
    assert pairs(trace.read_weighted_trace(spark, path, cap=18)) == [(1, 4), (2, 4)]
    near = write(tmp_path / "n.txt", f"1 {trace.WEIGHT_CAP - 1}\n2 1\n")
    assert pairs(trace.read_weighted_trace(spark, near, cap=trace.WEIGHT_CAP)) == [(1, trace.WEIGHT_CAP - 1)]
    assert len(pairs(trace.read_weighted_trace(spark, near))) == 2


def test_trace_cut_over_many_splits(spark, tmp_path):
    lines = [f"{i} {i % 9 + 1}" for i in range(5000)]
    path = write(tmp_path / "big.txt", "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 4
        got = trace.read_weighted_trace(spark, path, cap=12000)
        want, total = [], 0
        for i in range(5000):
            if total + i % 9 + 1 >= 12000:
                break
            total += i % 9 + 1
            want.append((i, i % 9 + 1))
        assert pairs(got) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_string_ids_and_uniform_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select(uniform(F.col("id"), 3).alias("u"), string_id(F.col("id").cast("string"), 60).alias("s"))
    a = sorted(map(tuple, df.repartition(3).collect()))
    b = sorted(map(tuple, df.repartition(7).collect()))
    assert a == b and all(0 <= u < 1 and 0 <= s < 2**60 for u, s in a)
    assert 0.45 < sum(u for u, _ in a) / 1000 < 0.55
    with pytest.raises(ValueError):
        string_id(F.lit("x"), 33)


def test_coefficients_repeat_and_differ():
    assert coefficients(1, 3, 4) == coefficients(1, 3, 4) != coefficients(2, 3, 4)
    assert all(1 <= r[0] < 2**31 - 1 and 1 <= r[2] for r in coefficients(5, 50, 4))


def plain_zipf(u, n, s):
    norm = sum(k ** -s for k in range(1, n))
    run = 0.0
    if u <= 0:
        return 0
    for k in range(1, n):
        run += k ** -s
        if run / norm >= u:
            return k
    return n - 1


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_zipf_draws_each_row_once(spark, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        us = [0.0, 1e-12, 0.3, 0.999999999999] + [i / 211 for i in range(1, 211)]
        df = spark.createDataFrame([(i, u) for i, u in enumerate(us)], "pos long, u double")
        got = {r.pos: r.item for r in synthetic.zipf_stream(df, F.col("u"), 100, 160, 1.1).collect()}
        assert got == {i: 100 + plain_zipf(u, 60, 1.1) for i, u in enumerate(us)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_zipf_over_many_blocks_of_ranks(spark):
    draws = synthetic.keys(spark, 4000).withColumn("u", uniform(F.col("pos"), 1))
    got = synthetic.zipf_streams(draws, F.col("u"), 0, 20000, [0.5, 1.0, 2.0])
    counts = {r.z: r["count"] for r in got.groupBy("z").count().collect()}
    assert counts == {0.5: 4000, 1.0: 4000, 2.0: 4000}
    top = got.where("z = 2.0 and item = 1").count()
    assert abs(top / 4000 - 6 / math.pi**2) < 0.03


def test_zeta_and_closed_form(spark):
    z = synthetic.zeta(spark, 1000, 0.7).first().zeta
    assert math.isclose(z, sum(i ** -0.7 for i in range(1, 1001)), rel_tol=1e-12)
    with pytest.raises(ValueError):
        synthetic.zipf_fast(F.lit(0.5), 10, 1.0, F.lit(1.0))
    got = spark.range(2000).select(
        synthetic.zipf_fast(uniform(F.col("id"), 2), 1000, 0.7, F.lit(z)).alias("k"))
    low, high = got.agg(F.min("k"), F.max("k")).first()
    assert low == 1 and high <= 1001


def test_distributions_have_the_right_shape(spark):
    u = [uniform(F.col("id"), s) for s in range(2)]
    got = spark.range(20000).select(
        synthetic.normal(u[0], u[1], 5.0, 2.0).alias("n"),
        synthetic.bernoulli(u[0], 0.25).cast("int").alias("b"),
        synthetic.uniform_int(u[0], 3, 8).alias("i"),
        synthetic.cauchy(u[0]).alias("c"),
        synthetic.stable(u[0], u[1], 1.5).alias("s"),
        synthetic.stable(u[0], u[1], 0.001).alias("a"))
    r = got.agg(
        F.avg("n"), F.stddev("n"), F.avg("b"), F.min("i"), F.max("i"),
        F.avg((F.abs("c") < 1).cast("int")), F.avg((F.col("s") > 0).cast("int")),
        F.avg((F.col("a") > 0).cast("int")), F.min(F.abs("a"))).first()
    assert abs(r[0] - 5) < 0.1 and abs(r[1] - 2) < 0.1 and abs(r[2] - 0.25) < 0.02
    assert (r[3], r[4]) == (3, 7)
    assert abs(r[5] - 0.5) < 0.02 and abs(r[6] - 0.5) < 0.02 and abs(r[7] - 0.5) < 0.02
    assert r[8] >= 1.0
    with pytest.raises(ValueError):
        synthetic.bernoulli(u[0], 1.5)


def test_scrambled_ids_stay_in_the_domain(spark):
    got = synthetic.zipf_updates(synthetic.keys(spark, 500), "pos", 4, 1.0, 1103515245, 12345, 4095)
    assert got.count() == 500
    assert got.where("item < 0 or item > 4095").isEmpty()


def test_reports_and_saved_results(spark, tmp_path):
    df = spark.createDataFrame([("im_sum", 99.5), ("dim_sum", 98.0)], "method string, recall double")
    write_report(df, str(tmp_path / "r"))
    text = [p.read_text() for p in (tmp_path / "r").glob("*.csv")]
    assert len(text) == 1 and text[0].splitlines()[0] == "method\trecall"
    assert read_report(spark, str(tmp_path / "r"), df.schema).count() == 2
    made = []

    def make():
        made.append(1)
        return df

    for _ in range(2):
        for sweep in ("epsilon", "gamma"):
            assert saved_sweep(spark, str(tmp_path / "s"), "zipf", sweep, make).count() == 2
    assert len(made) == 2
