"""The pipeline's last stage decodes what it encodes."""

import hashlib

import corpus_pipeline


def test_encoded_texts_come_back(spark, data, odd):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for df in (spark.read.parquet(f"{data}/documents.parquet").select(*columns), odd.select(*columns)):
        out = corpus_pipeline.STAGES[-1][1](spark, df, data)
        want = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in df.collect())
        got = out.collect()
        assert all(r.round_trip for r in got) and sorted(r.decoded_sha256 for r in got) == want
