import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from epochflow.llm import bpe, secret_grammar  # noqa: E402

from test_simhash import jaccard_components  # noqa: E402


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage returns, the documents first."""
    sf = "/root/testdata/sf0.01"
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(corpus_pipeline.written(stage(spark, docs[-1], sf), name))
    return [d.collect() for d in docs]


def test_columns_and_stages(spark, kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mix", "bpe"]
    assert all(tuple(rows[0].asDict()) == corpus_pipeline.COLUMNS for rows in kept[1:5])


def test_toxic_documents_go_and_clean_ones_stay(spark, kept):
    words = re.compile(r"\b(moron|loser|scum|clown|stupid|disgusting|worthless|idiot|pathetic|trash)\b", re.I)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    left = {d.doc_id for d in kept[1]}
    assert all(d.doc_id in left for d in kept[0] if labels.get(d.doc_id) == 0)
    hits = [d.doc_id for d in kept[0] if len(set(map(str.lower, words.findall(d.text)))) >= 2]
    assert sum(i in left for i in hits) <= 0.1 * len(hits)


def test_one_document_of_each_group_stays(kept):
    groups = jaccard_components([(d.doc_id, d.text) for d in kept[1]])
    assert sorted(d.doc_id for d in kept[2]) == sorted(set(groups.values()))


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Null ids, texts and sources, empty texts, repeated rows, extra columns with names that stages use, an empty table."""
    spark.createDataFrame([(1, 0), (None, 1), (3, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(1, "some plain words here", "en", "a", 4), (1, "some plain words here", "en", "a", 4), (None, "other words of no id", None, None, 5), (2, None, "en", "a", None), (3, "", "en", None, 0), (4, "w " * 30000, "en", "b", 60000)]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size string, _key0 string, toxicity string")
    seen = []
    for part in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            part = corpus_pipeline.written(stage(spark, part, str(tmp_path)), name)
            seen.append(part.collect())
    assert sorted(str(r.doc_id) for r in seen[1]) == ["1", "2", "4", "None"]
    assert all(r.text is None or r.text for r in seen[2]) and len(seen[2]) == 4
    assert all(tuple(r.asDict()) == corpus_pipeline.COLUMNS for rows in seen[:4] for r in rows)
    assert {str(r.doc_id) for r in seen[4]} <= {"1", "2", "4", "None"} and all(r.n_tokens == len(r.ids) for r in seen[4])
    assert seen[5:] == [[]] * 5


def test_secrets_are_masked_and_all_documents_stay(kept):
    before = {d.doc_id: d for d in kept[2]}
    assert before.keys() == {d.doc_id for d in kept[3]} and len(before) == len(kept[3])
    for d in kept[3]:
        assert not [s for s in secret_grammar.base_spans(d.text)[0] if s[2] != "assign"] and d.n_chars == len(d.text)
        if not secret_grammar.base_spans(before[d.doc_id].text)[0]:
            assert d.text == before[d.doc_id].text


def test_mix_and_token_ids(kept):
    sizes = lambda rows: {s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", d.text)) for d in rows if d.source == s) for s in {r.source for r in rows}}
    before, after = sizes(kept[3]), sizes(kept[4])
    assert abs(sum(after.values()) - 1.5 * sum(before.values())) <= len(before)
    assert all(after[s] <= 2 * before[s] for s in after)
    coder = bpe.load(corpus_pipeline.byte_bpe_path())
    texts = sorted((d.doc_id, tuple(coder.encode(d.text))) for d in kept[4])
    assert texts == sorted((r.doc_id, tuple(r.ids)) for r in kept[5]) and all(r.n_tokens == len(r.ids) for r in kept[5])
