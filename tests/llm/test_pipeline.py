"""The pipeline, stage by stage, against brute force on small tables."""

import hashlib
import re

import corpus_pipeline
from clauseplan.llm import quality_rules
from clauseplan.llm.queries import ORACLES, QUERIES, piece_model

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], FOLDER).cache())
    assert all(d.columns == docs.columns for d in seen[:-1])
    kept = {i for i, r in rows.items() if not any(x.rejects(quality_rules.Facts(r.text)) for x in quality_rules.RULES)}
    assert {r.doc_id for r in seen[1].collect()} == kept
    lower = kept - _near_copies({i: rows[i].text for i in kept})
    assert {r.doc_id for r in seen[2].collect()} == lower
    assert {r.doc_id for r in seen[3].collect()} == lower
    drawn = {r.doc_id: r.text for r in seen[4].collect()}
    assert 0 < len(drawn) <= len(lower)
    library = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    assert {r.doc_id: r.ids for r in seen[5].collect()} == {i: library.encode(t) for i, t in drawn.items()}


def _near_copies(texts):
    """Ids from which links of five-word Jaccard similarity 0.8 or more reach a smaller id."""
    sets = {}
    for i, t in texts.items():
        words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(len(words), 1)))}
    links = {i: {j for j in sets if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in sets}
    gone = set()
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        if min(seen) < i:
            gone.add(i)
    return gone


def test_awkward_rows_and_empty_tables(spark, edge_docs, empty_docs):
    """Stages in a row over nulls, empty and long texts, repeats and clashing column names, and over nothing."""
    for docs in (edge_docs, empty_docs):
        columns, rows = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER).cache()
            assert docs.count() <= rows
            rows = docs.count()
            if name != "encoding":
                assert docs.columns == columns
    assert rows == 0


def test_run_is_repeatable(spark):
    def digest():
        rows = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, FOLDER).collect())
        return hashlib.sha256(repr(rows).encode()).hexdigest()

    assert digest() == digest()


def test_every_query_is_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES) and corpus_pipeline.ORACLE_SQL is None
