import os
import re

import corpus_pipeline
from fathom.llm import quality, secrets, toxicity
from fathom.llm.bpe import encode_bpe
from tests.llm.helpers import SF
from tests.llm.test_packing import check


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "secrets", "packing"]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, seen[-1], SF)
        assert out.schema.simpleString() == docs.schema.simpleString()
        seen.append(spark.createDataFrame(out.collect(), docs.schema))
    rows = [{r.doc_id: r for r in df.collect()} for df in seen]
    model = toxicity.fit_from_labels(docs, labels)
    s = toxicity.Scorer(model)
    assert set(rows[1]) == {i for i, r in rows[0].items() if s.scores([r.text])[0] <= model.threshold}
    judged = {r.doc_id: r for r in quality.clean_lines(seen[1]).collect()}
    assert set(rows[2]) == {i for i, r in judged.items() if r.kept} and all(r.text == judged[i].clean_text and r.n_chars == len(r.text) for i, r in rows[2].items())
    texts = [r.text for r in rows[3].values()]
    assert len(texts) == len(set(texts)) and {r.text for r in rows[2].values()} >= set(texts) and len(texts) > 0.5 * len(rows[2])
    for i, r in rows[4].items():
        for rule in secrets.RULES:
            assert not re.search(rule.pattern, r.text, re.ASCII), (i, rule)
    assert set(rows[4]) == set(rows[3])
    packed = corpus_pipeline.STAGES[4][1](spark, seen[4], SF).collect()
    ids = {r.doc_id: r.token_ids for r in encode_bpe(seen[4], keep=["doc_id"]).collect()}
    check(packed, {i: len(t) for i, t in ids.items()}, 2048)
    assert all(r.token_ids == ids[r.doc_id][r.doc_start : r.doc_start + r.n_tokens] for r in packed)


def test_run(spark):
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")))
    out = corpus_pipeline.run(spark, SF)
    left = set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))) - before
    assert len(left) == 1 and left.pop().startswith("stage-packing-")
    assert out.columns == ["doc_id", "row_id", "window_id", "window_offset", "doc_start", "n_tokens", "token_ids"] and out.count() > 100


def test_odd_rows(spark, tmp_path):
    text = "This is a fine sentence about the sea and the shore."
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, text, None, None, None), (3, text, None, None, None), (None, text + " More of it here.", "en", "s", 9), (4, (text + "\n") * 5000, "en", "s", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, r in (("some", rows), ("none", [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(r, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        got = corpus_pipeline.run(spark, d).collect()
        assert bool(got) == bool(r)
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()} <= {None, 3, 4}
