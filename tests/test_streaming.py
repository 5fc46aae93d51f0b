from flowloom.streaming.ingest import ingest

SCHEMA = "src string, dst string, block_number long, value string, behaviour string, asset string"


def test_every_transfer_lands_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a", "b", i * 30, str(i) if i % 4 else "9" * 40, "ET", "t") for i in range(20)]
    for half in (rows[:10], rows[10:]):
        spark.createDataFrame(half, SCHEMA).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        for q in ingest(stream, out, str(tmp_path / "state"), slice_blocks=100, once=True):
            q.awaitTermination(60)
            assert q.exception() is None
    good, bad = (spark.read.parquet(f"{out}/{n}") for n in ("accepted", "rejected"))
    assert sorted(int(r["value"]) for r in good.collect()) == [i for i in range(20) if i % 4]
    assert bad.count() == 5 and {r["slice"] for r in good.select("slice").collect()} == set(range(6))
