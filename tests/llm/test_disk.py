"""Disk of steps that are over."""

import time

from tidemark.llm.components import connected_components


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_rounds_leave_no_shuffle_files(spark):
    """The files of every round stayed until the driver collected its garbage."""
    before, key = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(key)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    out = connected_components(edges)
    left = {-1}
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(key) == kept
    assert sorted(map(tuple, out.collect())) == [(i, 0) for i in range(1, 61)]


def test_tasks_of_rounds_follow_the_edges(spark):
    """Every exchange of a round had as many tasks as the session has shuffle partitions, however few edges there were."""
    parts, adaptive = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before = {k: spark.conf.get(k) for k in (parts, adaptive)}
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long").coalesce(1)
    tracker = spark.sparkContext.statusTracker()
    spark.conf.set(parts, "60")
    spark.conf.set(adaptive, "false")
    spark.sparkContext.setJobGroup("rounds", "rounds")
    try:
        out = connected_components(edges)
        jobs = tracker.getJobIdsForGroup("rounds")
        stages = {s for j in jobs for s in tracker.getJobInfo(j).stageIds}
        done = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, out.collect())) == [(i, 0) for i in range(1, 61)]
    print("tasks", done)
    assert done < 2500
