from pyspark.sql import functions as F

from weftgraph.llm import _common


def test_settled_steps_collect_what_is_free(spark, monkeypatch):
    """The JVM collects its whole heap after a settled step, but only once the heap has grown."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    for share, more in ((2.0, False), (0.0, True)):
        monkeypatch.setattr(_common, "GROWN", share, raising=False)
        before = whole()
        assert [r.id for r in _common.settle(spark.range(3)).orderBy("id").collect()] == [0, 1, 2]
        assert (whole() > before) is more


def test_native_memory_is_handed_back(spark):
    assert "rim" in _common.trim_native(spark)


def test_lookup_tables_of_long_arrays_are_not_broadcast(spark, monkeypatch):
    """Few rows that hold many items go by salts, with the same rows found."""
    monkeypatch.setattr(_common, "BROADCAST_ROWS", 100)
    dim = spark.range(20).select("id", F.sequence(F.lit(1), F.lit(50)).alias("items"))
    rows = spark.range(40).select((F.col("id") % 25).alias("id"), F.col("id").alias("x"))
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    heavy = _common.lookup(rows, dim, "id", F.col("x"), weight=F.size("items"))
    light = _common.lookup(rows, dim, "id", F.col("x"))
    assert "broadcast" in plan(light).lower() and "broadcast" not in plan(heavy).lower()
    ids = lambda df: sorted((r.id, r.x, len(r["items"])) for r in df.collect())
    assert ids(heavy) == ids(light) and len(ids(heavy)) == 35
