"""The pipeline against its stages in plain code, and on odd rows."""

import duckdb
import pytest

import corpus_pipeline
from plumeria.llm import pieces
from plumeria.llm.language import document_languages
from plumeria.llm.mixing import MIX_SQL

from . import brute
from .test_texts import full_search

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    fits = {r.doc_id for r in document_languages(docs).where("accepted").collect()}
    kept = {d: r for d, r in rows.items() if d in fits}
    group = brute.jaccard_join([(d, r["text"]) for d, r in kept.items()], 5, 80)
    kept = {d: r for d, r in kept.items() if group[d][1] == d}
    cut = brute.cut([(d, r["text"]) for d, r in kept.items()], 50)
    table = [(d, cut[d][3].decode("utf-8", "ignore"), kept[d]["source"]) for d in kept]  # noqa: F841
    import pandas as pd

    frame = pd.DataFrame(table, columns=["doc_id", "text", "source"])
    c = duckdb.connect()
    c.register("mixed", frame)
    taken = c.execute(f"SELECT doc_id, size, taken FROM ({MIX_SQL.format(docs='mixed')})").fetchall()
    v = pieces.load_pieces()
    texts = dict(zip(frame.doc_id, frame.text))
    want = []
    for d, size, n in taken:
        if n:
            ids = [k for w in ([texts[d]] if len(texts[d]) < 4000 else []) for k in full_search(v, w)]
            want += [(d, ids if len(texts[d]) < 4000 else None)] * (n // size)
    got = [(r.doc_id, r.ids if len(texts[r.doc_id]) < 4000 else None) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(fits) > 150


ODD = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (None, "the word that was with the other thing and then it stood there", "en", "a", 9), (4, "一天明" * 40, "en", "b", 3),
    (5, "the word that was with the other thing and then it stood here again", "en", "a", 9), (5, "the word that was with the other thing and then it stood here again", "en", "a", 9), (6, "the", "en", "a", 1),
]


@pytest.mark.parametrize("n", [0, len(ODD)])
def test_stages_on_odd_rows(spark, n):
    docs = spark.createDataFrame([(*r, "k", 7) for r in ODD][:n], "doc_id long, text string, lang string, source string, n_chars long, home string, n_bytes int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        if name == "n-gram Jaccard join" and n:
            assert sum(r.doc_id == 5 for r in docs.collect()) == 1
    assert all(r.home == "k" and r.n_bytes == 7 for r in docs.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and (n == 0 or any(r.doc_id is None for r in last.collect()))
