"""What operators leave on disk while they work."""

from clauseplan.llm import shared, suffix_dedup


def files(spark):
    """Shuffle blocks that the block manager still has on disk."""
    every = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {every.apply(i).getName() for i in range(every.size()) if every.apply(i).getName().startswith("shuffle_")}


def test_suffix_dedup_frees_its_first_shuffles(spark):
    """Shuffles of blocks and anchors are gone before segments are moved; the few left choose common anchors."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = files(spark)
    result = suffix_dedup.removals(docs)
    shuffles = {name.split("_")[1] for name in files(spark) - before}
    assert len(shuffles) <= 1
    assert result.count() == docs.count()


def test_settled(spark):
    frame = spark.range(1000).groupBy((shared.F.col("id") % 7).alias("k")).count()
    before = files(spark)
    rows = shared.settled(frame)
    assert files(spark) <= before and sorted(r["count"] for r in rows.collect()) == sorted(r["count"] for r in frame.collect())
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
