"""The pipeline's near-duplicates go through SimHash, and every pair is checked by its sets."""

import random

import pyarrow as pa
import pytest

import corpus_pipeline
from clauseplan.llm import near_copies, simhash


@pytest.fixture
def without_bands(monkeypatch):
    """MinHash bands bring no candidates."""

    def none(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([*(pa.array([], pa.int64()) for _ in range(5)), pa.array([], pa.bool_())], names=["key", "a", "b", "na", "nb", "many"])

    monkeypatch.setattr(near_copies, "_heads", none)


def test_links_within_the_radius(spark, without_bands):
    rng = random.Random(4)
    rows, want = [], set()
    for k in range(30):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
        other = [*words, "end"]
        near = (simhash.fingerprint(" ".join(words)) ^ simhash.fingerprint(" ".join(other))).bit_count() <= simhash.RADIUS
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        want |= {2 * k} if near else {2 * k, 2 * k + 1}
    assert len(want) < 45
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert {r.doc_id for r in got.collect()} == want


def test_equal_fingerprints_are_checked(spark, monkeypatch, without_bands):
    """Texts with one fingerprint and little in common stay; those with much in common don't."""
    words = [f"v{i}" for i in range(100)]
    texts = [" ".join(words), " ".join([*words, "x"]), " ".join([*words, "x", "y"]), " ".join(f"u{i}" for i in range(100))]
    real = near_copies._nodes
    monkeypatch.setattr(near_copies, "_nodes", lambda *a: real(*a).withColumn("fp", near_copies.F.lit(5).cast("long")))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r._id: r.component_id for r in near_copies.grouped(docs).collect()}
    assert got[3] == 3 and len({got[0], got[1], got[2]}) < 3 and all(got[i] < 3 for i in range(3))


def test_ids_that_only_seem_marked(spark, monkeypatch):
    """With a table of few bits, where every document seems marked, the joins decide."""
    monkeypatch.setattr(near_copies, "marks", lambda keys: near_copies.np.full(1 << 20, -1, near_copies.np.int64))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, "g h i j k l"), (None, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id for r in near_copies.one_of_each(docs).collect()), key=repr) == [1, 3, None]
