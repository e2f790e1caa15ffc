import re

from pyspark.sql import functions as F

import corpus_pipeline
from convoscore.llm.common import table
from convoscore.llm.quality import fit_quality, quality_scores

from .fixtures import DOCS, frame, prose
from .test_dedup import brute_exact, brute_near

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, after = {r.doc_id for r in docs.select("doc_id").collect()}, stage(spark, docs, SF)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        rows = [tuple(r) for r in docs.collect()]
        docs = spark.createDataFrame(after.collect(), docs.schema)
        kept = {r.doc_id for r in docs.collect()}
        assert kept < before or name != "quality"
        if name == "exact":
            assert kept == {r[1] for r in brute_exact(rows)}
        if name == "near":
            assert kept == {r[2] for r in brute_near(rows, 5)}
    mixed = corpus_pipeline.mixing(spark, docs, SF)
    assert mixed.columns == docs.columns and 1.3 < mixed.count() / docs.count() < 2
    encoded = corpus_pipeline.encode(spark, mixed, SF).collect()
    assert len(encoded) == mixed.count() and all(r.round_trip for r in encoded)


def test_stages_stand_odd_rows_and_clashing_columns(spark):
    """Each stage against what it must keep of odd rows, among columns with names of its own."""
    docs = frame(spark)
    whole = lambda df: sorted(map(repr, df.collect()))
    forest = fit_quality(docs, table(spark, SF, "labels"))
    scores = quality_scores(docs, forest, score_col="own score")
    got = corpus_pipeline.quality(spark, docs, SF)
    assert got.columns == docs.columns and whole(got) == whole(scores.filter(F.col("own score") >= corpus_pipeline.LEAST_SCORE).drop("own score"))
    rows = [tuple(r)[:5] for r in docs.collect()]
    got = corpus_pipeline.exact(spark, docs, SF)
    bodies = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in got.collect()]
    assert got.columns == docs.columns and len(bodies) == len(set(bodies)) and set(bodies) == {re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows}
    got = corpus_pipeline.near(spark, docs, SF)
    texts = [r.text for r in got.collect()]
    numbered = [(k, *r[1:]) for k, r in enumerate(rows)]
    groups = [x[2] for x in brute_near(numbered, 5)]
    of = {r[1]: g for r, g in ((r, next(x[2] for x in brute_near(numbered, 5) if x[0] == r[0])) for r in numbered) if (r[1] or "").split()}
    assert got.columns == docs.columns and len(texts) == len(set(groups)) and len({of[t] for t in texts if t in of}) == len(set(of.values()))
    got = corpus_pipeline.mixing(spark, docs, SF)
    assert got.columns == docs.columns and set(whole(got)) <= set(whole(docs))
    encoded = corpus_pipeline.encode(spark, docs, SF)
    assert encoded.columns == [c for c in docs.columns if c not in ("text", "ids", "n_tokens", "Round_Trip")] + ["ids", "n_tokens", "round_trip"] and encoded.count() == len(rows)
    none = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "lang", "source", "ids", "n_tokens"} <= set(got.columns) and got.count() > 100


def test_stages_tell_rows_apart_without_ids(spark):
    one, two, three, four = (prose(120, 900 + k) for k in range(4))
    texts = [(None, one), (None, one), (None, two), (7, one), (7, three), (8, four), (8, four), (9, prose(120, 77))]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in texts], clash=False)
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(7, one), (0, two), (7, three), (8, four), (9, texts[-1][1])])
    rows = [(None if k % 2 else 5, prose(50, k), "en", "s", 0) for k in range(60)]
    took = [r.text for r in corpus_pipeline.mixing(spark, frame(spark, rows, clash=False), SF).collect()]
    assert len(took) == 90 and len({*took}) < 60 + 1 and max(took.count(t) for t in took) == 2 and min(took.count(t) for t in took) == 1


def test_run_against_plain_stages(spark, tmp_path):
    """The whole pipeline on a small table: what every stage keeps by brute force, copies by the mix's targets, and the
    library's own ids."""
    import sentencepiece

    from convoscore.llm.spm import PUBLIC_MODEL

    from .test_text_operators import plain_targets

    source = [tuple(r) for r in table(spark, SF, "documents").collect()]
    rows = source + [(100_000 + k, r[1] + " ", *r[2:]) for k, r in enumerate(source[:30])] + [(200_000 + k, prose(90, k), "en", None, 1) for k in range(12)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, SF, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    scores = quality_scores(docs, fit_quality(docs, table(spark, str(tmp_path), "labels")), score_col="own").collect()
    left = [tuple(r)[:5] for r in scores if r.own >= corpus_pipeline.LEAST_SCORE]
    keep = {r[1] for r in brute_exact(left)}
    left = [r for r in left if r[0] in keep]
    keep = {r[2] for r in brute_near(left, 5)}
    left = {r[0]: r for r in left if r[0] in keep}
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for i, r in left.items()}
    sizes: dict = {}
    for i, r in left.items():
        sizes[r[3]] = sizes.get(r[3], 0) + words[i]
    want, took, copies = plain_targets(sizes, [3, 1, 2], 1.5, 2), {}, {}
    theirs = sentencepiece.SentencePieceProcessor(model_file=PUBLIC_MODEL)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert r.doc_id in left and r.ids == theirs.encode(left[r.doc_id][1] or "") and r.n_tokens == len(r.ids) and r.round_trip
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        took[r.source] = took.get(r.source, 0) + words[r.doc_id]
    assert max(copies.values()) == 2 and len(left) < len(rows) - 30
    for s, target in want.items():
        assert abs(took.get(s, 0) - target) <= max(0.02 * target, max(words[i] for i, r in left.items() if r[3] == s))
