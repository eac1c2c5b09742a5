import time

from pyspark.sql import functions as F

from marlstone.llm import shared
from marlstone.llm.shared import Stash

from .helpers import table


def test_the_driver_collects_garbage_as_tables_are_written(spark):
    """A full collection within each TIDY_EVERY tables, after which the heap is small and old broadcasts may go."""
    jvm = spark.sparkContext._jvm
    full = lambda: sum(b.getCollectionCount() for b in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    stash, before = Stash(spark), full()
    for i in range(2 * shared.TIDY_EVERY):
        kept = stash.keep(table(spark, [(1, "a")]), f"t{i}")
    assert full() - before >= 2 and kept.count() == 1
    stash.drop()


def test_the_driver_collects_garbage_while_a_table_is_written(spark, monkeypatch):
    """A write that takes long has full collections before it ends, however few tables there are, and none once it is over."""
    monkeypatch.setattr(shared, "TIDY_S", 0.3, raising=False)
    monkeypatch.setattr(shared, "TIDY_EVERY", 10**9)
    jvm = spark.sparkContext._jvm
    full = lambda: sum(b.getCollectionCount() for b in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    stash, before = Stash(spark), full()
    slow = spark.range(0, 4, 1, 4).select("id", F.expr("java_method('java.util.concurrent.locks.LockSupport', 'parkNanos', 3000000000L)").alias("x"))
    kept = stash.keep(slow, "slow")
    after = full()
    assert after - before >= 2 and kept.count() == 4
    time.sleep(1)
    assert full() == after
    stash.drop()
