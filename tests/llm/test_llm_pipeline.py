import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
pytest.importorskip("public_tokenizers")

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the shared tables")
def test_stages_follow_each_other(spark):
    import corpus_pipeline as p
    from tokenizers import Tokenizer
    import public_tokenizers

    from strandloom.llm.store import stored
    from test_llm_near import components, lines_that_go, plain_fingerprint

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    frames = [docs]
    for name, stage in p.STAGES:
        frames.append(stored(stage(spark, frames[-1], SF)))
        kept.append(name)
    assert kept == ["quality_rules", "line_dedup", "simhash_dedup", "mix_sources", "bpe_encode"]
    assert all(f.columns == docs.columns for f in frames[:5])
    good, lined, single, mixed, coded = [f.collect() for f in frames[1:]]
    texts = {r.doc_id: r.text for r in good}
    gone = lines_that_go(list(texts.items()))
    assert {r.doc_id: r.text for r in lined} == {
        i: "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone) for i, t in texts.items()
    }
    lined = sorted(lined, key=lambda r: r.doc_id)
    roots = components([plain_fingerprint(r.text) for r in lined])
    assert sorted(r.doc_id for r in single) == sorted({lined[i].doc_id for i in roots})
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in single}
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_id = {r.doc_id: r.text for r in mixed}
    assert len(coded) == len(mixed)
    for r in coded:
        assert r.n_tokens == len(model.encode(by_id[r.doc_id], add_special_tokens=False).ids) == len(r.ids) // 4


def test_every_operator_has_its_query():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
