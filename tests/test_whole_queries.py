"""Registered queries that do their operator's whole job, against brute force."""

import re

import pytest

from orthant.operators import documents
from orthant.plans import queries

from test_queries import TABLES


def test_relevance_scores_and_ranks_chunks(spark):
    fill = " ".join(["filler"] * 30)
    texts = {1: f"red apple {fill}\n\nplain {fill}\n \nred {fill}", 2: f"{fill}\n\nblue {fill}", 3: "red apple here", 4: f"{fill}\n\nred pear {fill}\n\nred apple pear {fill}", 5: None, 6: ""}
    phrase, size, want = "red apple pear red", 240, []
    q = phrase.split()
    for doc, text in texts.items():
        of_doc = sum(w in (text or "").split() for w in q) / len(q)
        parts = [text] if len(text or "") <= size else re.split(r"\n\s*\n", text)  # no two of them fit into a chunk
        for i, part in enumerate(parts):
            own = sum(w in (part or "").split() for w in q) / len(q)
            if own and of_doc:
                want.append((doc, i, round(own + 0.3 * of_doc, 9)))
    want = sorted(want, key=lambda x: (-x[2], x[0], x[1]))
    docs = spark.createDataFrame(list(texts.items()), "doc long, text string")
    got = [(r.doc, r.chunk_no, r.score) for r in documents.relevance(docs, phrase, 10, size=size).collect()]
    assert got == want and (1, 2) in {x[:2] for x in got} and not {(1, 1), (4, 0)} & {x[:2] for x in got}


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
def test_relevance_is_registered_with_chunks(spark):
    assert any(r.chunk_no > 0 for r in queries.QUERIES["chunk_relevance"](spark, str(TABLES)).collect())


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
def test_neighbors_of_whole_orders_and_of_all_rows(spark):
    rows = queries.points(spark, str(TABLES)).select("guid", "pos.x").collect()
    whole = {r.guid for r in rows if r.x % 100 == 0}
    assert whole and {r.qid for r in queries.QUERIES["true_neighbors"](spark, str(TABLES)).collect()} == whole
    assert whole == {r.qid for r in queries.QUERIES["leaf_neighbors"](spark, str(TABLES)).collect()}
    assert {r.qid for r in queries.QUERIES["all_leaf_neighbors"](spark, str(TABLES)).collect()} == {r.guid for r in rows}
