"""op10_pieces: parity with the other library is counted over all words, not over a sample."""

from clauseplan.llm import pieces
from clauseplan.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_every_word_is_checked(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    words = {i: len(pieces._WORD.findall(pieces.MARK + t.replace(" ", pieces.MARK))) if t else 0 for i, t in texts.items()}
    got = QUERIES["op10_pieces"](spark, FOLDER).collect()
    assert {r.doc_id: r.n_checked for r in got} == words
    assert all(r.n_differ == 0 for r in got)
