from millrace.plans import bench

ROW = "query string, sf double, cores int, run int, seconds double, rows bigint, bytes bigint, tokens bigint"


def test_measures(spark, data):
    runs = bench.run_bench(spark, {"one": lambda s, d: s.range(10)}, data, 0.001, 2)
    assert runs.count() == 2 and runs.filter("seconds > 0").count() == 2
    assert bench.RUNS == ROW
    stored = spark.createDataFrame([("q", 0.1, c, k, s + k, 100, 500, 1000) for c, s in ((1, 8.0), (4, 2.0)) for k in range(3)], bench.RUNS)
    summary = bench.bench_summary(stored)
    assert {r.cores: (r.median_s, r.min_s, r.max_s, r.rows_s, r.bytes_s, r.tok_s) for r in summary.collect()} == {1: (9.0, 8.0, 10.0, 11.111, 55.556, 111.111), 4: (3.0, 2.0, 4.0, 33.333, 166.667, 333.333)}
    assert {r.cores: (r.speedup, r.efficiency) for r in bench.scaling(summary).collect()} == {1: (1.0, 1.0), 4: (3.0, 0.75)}
    slower = bench.bench_regression(summary, summary.withColumn("median_s", summary.median_s / 2))
    assert {r.slower for r in slower.collect()} == {True} and {r.ratio for r in slower.collect()} == {2.0}


def test_runs_are_kept(spark, data, tmp_path):
    path = f"file://{tmp_path}/runs"
    for _ in range(2):
        runs = bench.scan_runs(spark, data, 0.001, ("part", "nation"), (1, 2), path, 1)
    assert runs.count() == 8 and {(r.query, r.rows, r.bytes > 0) for r in runs.collect()} == {("part", 200, True), ("nation", 25, True)}
