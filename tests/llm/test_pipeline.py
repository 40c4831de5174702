import os
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from test_decontaminate import brute as leaks
from test_simhash import brute as groups
from weftgraph.llm import packing, pii, quality, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")


def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs)
    return out


def test_every_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII surrogates", "best-fit packing"]
    good, single, clean, private, packed = stages(spark)
    for kept in (good, single, clean, private):
        assert kept.columns == docs.columns
    # quality
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    learnt = sorted(i for i in labels if zlib.crc32(str(i).encode()) % 5 and i in rows)
    text = lambda i: (rows[i].text or "").encode()
    model = quality.fit(quality.matrix([text(i) for i in learnt]), np.array([labels[i] for i in learnt], float))
    ids = sorted(rows)
    want = {i for i, s in zip(ids, model.score(quality.matrix([text(i) for i in ids])), strict=True) if s >= 0.3}
    assert {r.doc_id for r in good.collect()} == want and len(want) < len(rows)
    # near duplicates
    ids = sorted(want)
    found = groups([simhash.fingerprint(text(i)) % 2**64 for i in ids], 4)
    want = {ids[k] for k in set(found)}
    assert {r.doc_id for r in single.collect()} == want and len(want) < len(ids)
    # benchmark
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    few = [i for i in want if any(t and t.split()[0].lower() in rows[i].text.lower() for _, t in items)]
    bad = {d for d, _ in leaks([(i, rows[i].text) for i in few], items)}
    assert {r.doc_id for r in clean.collect()} == want - bad
    # personal data
    want = {i: pii.replace(rows[i].text, {}) for i in want - bad}
    got = {r.doc_id: r for r in private.collect()}
    assert {i: r.text for i, r in got.items()} == {i: t for i, (t, _) in want.items()}
    assert all(r.n_chars == (len(r.text) if want[i][1] else rows[i].n_chars) for i, r in got.items())
    # packing
    whole, spans = packing.WordIds(packing.tokenizer_path()), defaultdict(list)
    pieces = packed.collect()
    assert {r.doc_id for r in pieces} == set(got)
    for r in pieces:
        spans[r.sequence_id].append((r.offset, r.length))
        if r.piece == 0 and r.length < 4096:
            assert r.ids_crc32 == zlib.crc32(whole.of(got[r.doc_id].text) + b"\1\0\0\0")
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_run_equals_the_stages(spark):
    rows = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages(spark)[-1])
