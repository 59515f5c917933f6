"""The stages one after the other, each against what it should have kept."""

import os
import re


import corpus_pipeline
from sparkloom.llm import decontaminate, jaccard_join, langid, line_dedup
from sparkloom.llm.stage import keep

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = keep(docs, "few")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = keep(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in out.collect()}
        assert after.keys() <= before.keys()
        assert out.columns[: len(docs.columns)] == docs.columns
        texts = [(d, r.text) for d, r in before.items()]
        if name == "language_id":
            assert after.keys() == before.keys() - {r.doc_id for r in langid.identify(docs).collect() if r.lang_pred == "und"}
        elif name == "line_dedup":
            gone = line_dedup.brute_force(texts)
            for d, text in texts:
                kept = "\n".join(x for k, x in enumerate(text.split("\n")) if (d, k) not in gone)
                if d in after:
                    assert after[d].text == kept and after[d].n_chars == len(kept)
                else:
                    assert not re.search(r"[^\x20\x09-\x0D]", kept)
        elif name == "near_duplicates":
            want = jaccard_join.brute_force(texts)
            assert after.keys() == set(want[want.doc_id == want.component_id].doc_id)
        elif name == "decontamination":
            assert after.keys() == before.keys() - {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
        else:
            assert out.columns[-1] == "weight" and all(r.weight >= 1 for r in after.values())
        docs = out
    assert docs.count() > 0
