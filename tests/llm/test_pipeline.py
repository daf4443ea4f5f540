import corpus_pipeline
from runlens.llm.language_id import fit, identify

from .helpers import SF
from .test_decontamination import brute as contaminated
from .test_packing import check as check_packing


def shingles(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, now = docs.columns, docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in now.collect()}
        out = stage(spark, now, SF)
        if name == "best_fit_packing":
            bins, least = check_packing(out.collect(), before, 2048)
            assert bins <= least * 1.05 + 1
            break
        assert out.columns == columns
        out = spark.createDataFrame(out.collect(), docs.schema)
        kept = {r.doc_id: r.text for r in out.collect()}
        assert all(kept[d] == before[d] for d in kept)
        gone = set(before) - set(kept)
        if name == "language_id":
            assert gone == {r.doc_id for r in identify(now, fit(now), host=now.source).collect() if not r.accepted}
            assert len(gone) < 0.05 * len(before)
        elif name == "exact_dedup":
            first = {}
            for d in sorted(before):
                first.setdefault(before[d] or "", d)
            assert set(kept) == set(first.values())
        elif name == "near_dedup":
            sets = {d: shingles(t) for d, t in before.items()}
            for d in kept:  # no two kept ones are near copies
                assert not any(d < e and jaccard(sets[d], sets[e]) >= 0.8 for e in kept)
            for d in gone:  # what goes has a near copy
                assert any(e != d and jaccard(sets[d], sets[e]) >= 0.8 for e in before)
        else:
            assert gone == {d for d, v in contaminated(before, bench).items() if v[4]}
        now = out


def test_run_gives_the_last_stage_and_leaves_little_behind(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    docs.write.parquet(str(tmp_path / "sf/documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "sf/benchmark.parquet"))
    monkeypatch.setattr("runlens.llm.common.shared_folder", lambda spark: f"file://{tmp_path}/shared")
    rows = corpus_pipeline.run(spark, str(tmp_path / "sf")).collect()
    left = sorted(p.name.split("-")[1] for p in (tmp_path / "shared").iterdir())
    assert left == ["pack", "pipeline"] and [p.name for p in next((tmp_path / "shared").glob("*-pipeline-*")).iterdir()] == ["decontamination"]
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, str(tmp_path / "sf")).collect(), docs.schema)
    assert {r.doc_id for r in rows} == {r.doc_id for r in now.collect()}


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
