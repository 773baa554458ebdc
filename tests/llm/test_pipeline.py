"""Stages against plain versions on a small table."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.fixtures import empty, odd
from tests.llm.test_neardup import brute
from vanewright.llm import common, packing

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, seen[-1], SF)
        if k < len(cp.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    raw, clean, lined, unique, mixed, packed = seen
    assert 0 < clean.count() <= raw.count() and lined.count() == clean.count()
    want = brute([(r["doc_id"], r["text"]) for r in lined.collect()], 5)
    assert {r["doc_id"] for r in unique.collect()} == {i for i, c in want.items() if i == c}
    assert {r["doc_id"] for r in mixed.select("doc_id").collect()} <= {r["doc_id"] for r in unique.select("doc_id").collect()}
    assert packed.where("piece = 0").count() == mixed.count() and packed.agg(F.max("length")).first()[0] <= 1024


def test_stages_on_odd_and_empty_rows(spark):
    rows, none = odd(spark), empty(spark)
    for name, stage in cp.STAGES[:-1]:
        out, nothing = stage(spark, rows, SF), stage(spark, none, SF)
        assert out.columns == rows.columns and nothing.columns == rows.columns and nothing.count() == 0, name
        got = out.collect()
        assert {r["component_id"] for r in got} <= {99} and len(got) == {"line_dedup": 16}.get(name, len(got)), name
        if name == "near_dedup":
            ids = sorted((r["doc_id"] for r in got), key=str)
            assert ids.count(7) == 2 and ids.count(None) == 2 and 2 not in ids and 1 in ids and {4, 5, 6} <= set(ids)
    packed = cp.STAGES[-1][1](spark, rows, SF)
    assert packed.where("piece = 0").count() == 16 and cp.STAGES[-1][1](spark, none, SF).count() == 0


def test_stages_hold_few_texts_at_once(spark, monkeypatch):
    """Parquet's reader and Arrow take texts in small batches, and packing keeps a smaller cache than by itself."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(n) for n in names]
    seen, plain = [], packing.tokenized
    monkeypatch.setattr(packing, "tokenized", lambda *a: seen.append(a[-1]) or plain(*a))
    try:
        for n in names:
            spark.conf.unset(n)
        cp.packing(spark, odd(spark), SF)
        assert all(int(spark.conf.get(n)) <= common.BATCH_ROWS for n in names) and seen[0] < packing.CACHE_ENTRIES
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
