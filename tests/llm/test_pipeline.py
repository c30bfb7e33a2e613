"""The stages of the pipeline on their own inputs, and end to end."""

from collections import Counter

import corpus_pipeline
from palimpsest.llm import near_dedup
from palimpsest.llm.common import documents, materialize
from tests.llm.conftest import BPE, frame  # noqa: F401
from tests.llm.test_operators import brute_classes, brute_spans, check_packing, words


def test_stages(spark, sf):
    docs = documents(spark, sf)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, sf)
        if name == "best-fit packing":
            check_packing(out.collect(), before)
            break
        assert out.columns == columns
        after = [(r["doc_id"], r["text"]) for r in out.collect()]
        if name == "quality classifier":
            assert 0.6 * len(before) < len(after) <= len(before) and set(after) <= set(before)
        elif name == "exact dedup":
            best = {}
            for i, t in before:
                best[t or ""] = max(i, best.get(t or "", i))
            assert Counter(i for i, _ in after) == Counter(best.values())
        elif name == "near dedup":
            assert sorted(i for i, _ in after) == sorted({c for _, c, _ in brute_classes(before)})
        else:
            want = {i: n - gone for i, n, gone, _ in brute_spans(before, 35)}
            assert {i: len(words(t)) for i, t in after} == {i: n for i, n in want.items() if n or not words(dict(before)[i])}
        docs = out
    assert near_dedup.THRESHOLD == 0.8


def test_stages_on_odd_rows_and_clashing_names(spark, sf, odd_rows, tmp_path):
    spark.createDataFrame([(i, i % 2, 0) for i in range(14)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (frame(spark, odd_rows), frame(spark, odd_rows, extra=False), frame(spark, [(1, "a")]).where("doc_id < 0")):
        columns = docs.columns
        before = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name == "best-fit packing":
                check_packing(out.collect(), [(r[0], r[1]) for r in docs.collect()])
                break
            assert out.columns == columns
            docs = materialize(out, "stage") if len(set(map(str.lower, columns))) == len(columns) else out
            after = docs.count()
            assert after <= before
            before = after


def test_exact_stage_on_odd_rows(spark, sf, odd_rows):
    docs = corpus_pipeline.exact_stage(spark, frame(spark, odd_rows), sf)
    assert Counter(r[1] or "" for r in docs.collect()) == Counter({t or "": 1 for _, t in odd_rows})


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0
