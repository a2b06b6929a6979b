"""Shared helpers."""

from __future__ import annotations

import os

import pyarrow as pa

from pixelframe.llm import common


def test_written_and_discarded(spark):
    df = common.written(spark.range(5), "five")
    assert sorted(r["id"] for r in df.collect()) == [0, 1, 2, 3, 4]
    folder = f"{common.shared_dir(spark)}/pixelframe-{spark.sparkContext.applicationId}"
    assert os.path.isdir(folder)
    common.discard(spark)
    assert not os.path.exists(folder)


def test_scratch_keeps_only_what_is_written_outside(spark):
    base = common.tables(spark)
    with common.scratch(spark) as folder:
        assert folder == base
        inner = common.written(spark.range(4), "inner")
        with common.scratch(spark) as second:
            kept = common.written(inner.where("id > 1"), "second", second)
        kept = common.written(kept, "kept", folder)
    assert sorted(r["id"] for r in kept.collect()) == [2, 3]
    assert not [x for x in os.listdir(base.removeprefix("file:")) if x.startswith("scratch")]
    common.discard(spark)


def test_small_tables_are_dealt_out(spark, tmp_path):
    rows = spark.range(50).selectExpr("id", "id % 3 AS k")
    for files in (1, 9):
        rows.repartition(files).write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
        got = common.table(spark, str(tmp_path), "t")
        assert got.columns == rows.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
        assert ("Repartition" in got._jdf.queryExecution().optimizedPlan().toString()) == (files == 1)


def test_columns_packed_and_unpacked(spark):
    df = spark.createDataFrame([(1, "a", None)], "row int, c0 string, `__row` string")
    got = common.unpacked(df.select(common.packed(df).alias("row")), "row", df.columns)
    assert got.columns == df.columns and got.schema == df.schema and got.collect() == df.collect()


def test_batches_by_bytes():
    texts = ["a" * n for n in (1, 5, 5, 100, 1, 1)] + [None, ""]
    cut = list(common.by_bytes([pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])], "t", 10))
    assert [x for b in cut for x in b.column("t").to_pylist()] == texts
    assert [b.num_rows for b in cut] == [2, 1, 1, 4]


def test_both_ways_of_joining(spark):
    left, right = spark.range(6).withColumnRenamed("id", "k"), spark.range(3).selectExpr("id AS k", "id * 2 AS v")
    for row_bytes in (8, 1 << 30):
        got = common.join_small(left, right, "k", "left", row_bytes).orderBy("k").collect()
        assert [r["v"] for r in got] == [0, 2, 4, None, None, None]


def test_written_gives_the_drivers_native_memory_back(spark):
    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    field = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    native = field.get(None)

    def held() -> int:
        with open(f"/proc/{pid}/smaps_rollup") as f:
            return sum(int(x.split()[1]) for x in f if x.startswith("Pss_Anon:")) >> 10

    # 1,500 pieces of 100 KB, of which every 50th stays, so that the allocator gives nothing back by itself
    at = [native.allocateMemory(100_000) for _ in range(1500)]
    for x in at:
        native.setMemory(x, 100_000, 1)
    try:
        for i, x in enumerate(at):
            if i % 50:
                native.freeMemory(x)
        before = held()
        common.written(spark.range(3), "three")
        assert held() < before - 60
    finally:
        for x in at[::50]:
            native.freeMemory(x)
        common.discard(spark)
