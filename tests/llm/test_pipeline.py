"""The pipeline against a brute-force version of each stage, and its edges."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from orrery.llm import packing, toxicity
from tests.llm.test_operators import brute_components, brute_spans

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def hidden(text):
    at, out = 0, ""
    for a, _, _, b in brute_spans(text):
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return None if text is None else out + text[at:]


def test_run_is_the_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    stems = toxicity.Stems(model.stems)
    rows = [(r.doc_id, r.text) for r in docs.collect() if toxicity._score(model, stems, r.text or "") < 0.5]
    groups = brute_components(rows, 5, 80)
    rows = [(i, hidden(t)) for i, t in rows if groups[i][1] == i]
    bpe = packing.word_bpe("word_bpe_49k.json")
    expected = []
    for i, t in rows:
        ids = np.append(bpe.encode(t or ""), 1).astype("<u4")
        expected += [(i, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(expected)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_and_bear_odd_rows(spark, sf, stage):
    rows = [(1, "clean words here", "en", None, 16), (1, "clean words here", "en", None, 16), (None, None, None, None, None), (2, "", None, "s", 0), (3, "clean  words here", "en", "s", 17)]
    docs = spark.createDataFrame(rows, DOCS)
    f = dict(corpus_pipeline.STAGES)[stage]
    out = f(spark, docs, sf)
    assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    ids = sorted(str(r.doc_id) for r in out.collect())
    assert ids == (["1", "2", "None"] if stage == "near_duplicates" else ["1", "1", "2", "3", "None"])
    assert f(spark, docs.limit(0), sf).count() == 0


def test_near_duplicates_keeps_every_unlinked_text(spark, sf):
    """Texts without an id or with a repeated one are groups of their own, or copies of what they link with."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    rows = [(3, a), (5, a), (5, b), (None, c), (None, d), (None, d), (None, b), (7, d), (8, e), (8, e), (8, ""), (8, None), (9, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], DOCS)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(i), str(t)) for i, t in [(3, a), (5, b), (None, c), (7, d), (8, e), (8, ""), (8, None), (9, ""), (None, "")])


def test_stages_bear_dotted_names_maps_and_long_texts(spark, sf):
    long = " ".join(f"w{i}" for i in range(300_000))
    docs = spark.createDataFrame([(1, "token: abcdefgh", {"k": 1}, 1.5, 15), (1, "token: abcdefgh", {"k": 2}, 2.5, 15), (2, None, None, None, None), (3, long, {}, 0.0, 1)], "doc_id long, text string, `m` map<string,int>, `a.b``c` double, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        rows = out.collect()
        assert len(rows) == (3 if name == "near_duplicates" else 4) and max(len(r.text or "") for r in rows) == len(long)


def test_stages_bear_columns_named_like_their_helpers(spark, sf):
    docs = spark.createDataFrame([(1, "token: abcdefgh", "k", "b", ["s"], 3), (2, None, None, None, None, 4)], "doc_id long, text string, key string, blob string, spans array<string>, row long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and sorted(str(tuple(r)[2:]) for r in out.collect()) == sorted(str(tuple(r)[2:]) for r in docs.collect()), name
