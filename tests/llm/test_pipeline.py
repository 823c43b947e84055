import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import mixing, queries
from ledgerloom.llm.common import written
from ledgerloom.llm.parameters import byte_tokenizer


def test_stages(spark, documents, prose, tmp_path):
    item = prose("item", 30)
    rows = [(k, prose(k, 120), "xx", f"s{k % 3}") for k in range(60)]
    rows += [(100, rows[0][1].upper(), "xx", "s0"), (101, prose("q", 60) + " " + item, "xx", "s1"), (102, None, "xx", "s1"), (103, "123", None, None)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, columns = documents(rows), None
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = written(stage(spark, docs, str(tmp_path)), "test")
        seen[name] = docs
        if name != "token_ids":
            assert docs.columns == columns
    ids = {name: sorted(r.doc_id for r in df.collect()) for name, df in seen.items()}
    assert ids["language_id"] == [*range(60), 100, 101]
    assert ids["near_duplicates"] == [*range(60), 101]
    assert ids["decontamination"] == [*range(60)]
    want = mixing.mixed(seen["decontamination"], corpus_pipeline.source_weights, corpus_pipeline.source_schedules)
    assert ids["source_mix"] == sorted(r.doc_id for r in want.collect()) == ids["token_ids"]
    library, at, texts = Tokenizer.from_file(byte_tokenizer()), 0, {r[0]: r[1] for r in rows}
    for r in sorted(seen["token_ids"].collect(), key=lambda r: r.start):
        own = np.array([*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)


def test_whole_run(spark):
    assert queries.QUERIES["pipeline"](spark, "/root/testdata/sf0.001").count() > 0
