"""The pipeline's near-duplicates against brute-force groups by five-word Jaccard similarity."""

import itertools
import random

import pyarrow as pa
import pytest

import corpus_pipeline
from clauseplan.llm import near_copies


def runs(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_kept(rows):
    sets = {i: runs(t) for i, t in rows}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
            low, high = sorted((root(a), root(b)))
            least[high] = low
    return {i for i in sets if root(i) == i}


@pytest.fixture(scope="module")
def edited():
    """Texts of 40 to 400 words with chains of edited copies around similarity 0.8, and a passage that many share."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(900)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(40, 400))] + passage * (k % 2)
        for _ in range(rng.randint(1, 6)):
            rows.append(" ".join(words))
            words = list(words)
            for at in rng.sample(range(len(words)), max(1, int(len(words) * rng.uniform(0.005, 0.03)))):
                words[at] = rng.choice(vocabulary).upper()
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_edited_copies(spark, edited):
    docs = spark.createDataFrame(edited, "doc_id long, text string").repartition(3)
    want = brute_kept(edited)
    assert len(want) < len(edited)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want


def test_parts_of_large_values(spark, edited):
    docs = spark.createDataFrame(edited, "doc_id long, text string").repartition(3)
    got = near_copies.grouped(docs, most=2).collect()
    assert {r.component_id for r in got} == brute_kept(edited) and len(got) == len(edited)


def test_awkward_rows(edge_docs, edge_rows, empty_docs):
    stay = near_copies.one_of_each(edge_docs)
    assert stay.columns == edge_docs.columns
    got = sorted((r.doc_id for r in stay.collect()), key=repr)
    want = brute_kept([r for r in edge_rows if r[0] is not None])
    assert got == sorted((i for i, _ in edge_rows if i is None or i in want), key=repr)
    assert near_copies.one_of_each(empty_docs).count() == 0


def test_documents(spark):
    """Real documents, at a size where brute force is quick."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want


@pytest.mark.parametrize("step", [1, 2, 3, 7, 100])
def test_heads_over_batches(step):
    """Keys with one, two and many rows, cut into batches at every place."""
    rng = random.Random(step)
    rows = sorted((k, node, node % 9) for k in range(40) for node in rng.sample(range(1000), rng.choice([1, 2, 3, 4, 30])))
    want = []
    for key in range(40):
        (_, a, na), *rest = [r for r in rows if r[0] == key]
        want += [(key, a, b, na, nb, len(rest) > 1) for _, b, nb in rest]
    cut = [rows[i : i + step] for i in range(0, len(rows), step)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], names=["key", "node", "n"]) for part in cut]
    batches.insert(1, batches[0].slice(0, 0))
    got = [tuple(r.values()) for b in near_copies._heads(iter(batches)) for r in b.to_pylist()]
    assert got == want
    assert [b.num_rows for b in near_copies._heads(iter([]))] == [0]
