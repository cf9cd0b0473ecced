"""The pipeline's stages on a small folder of tables, against what each should do alone."""

import corpus_pipeline
from causeway.llm import decontaminate, near_dedup, pii, toxicity
from tests.llm.test_documents import corpus, frame, labelled


def test_stages(spark, tmp_path):
    rows, _, _, labels = labelled(spark)
    more = {1000 + i: t for i, t in corpus(n=40).items()} | {2000: "write to me@here.org about the river and the stone under the garden tonight"}
    docs = frame(spark, rows | more)
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(*names).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    item = " ".join((rows[1] or "").split()[:30])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == names, name
        was, now = ({r.doc_id: r.text for r in x.collect()} for x in (before, after))
        if name == "toxicity":
            assert set(was) - set(now) == {r.doc_id for r in toxicity.toxicity(before, labels).filter("rejected").collect()} != set()
        elif name == "near_dedup":
            assert set(now) == {r.doc_id for r in near_dedup.near_duplicates(before).filter("kept").collect()} != set(was)
        elif name == "decontamination":
            assert set(was) - set(now) == {r.doc_id for r in decontaminate.contained(before, bench).collect()} and 1 not in now
        else:
            field = pii.fit(before)
            assert now == {i: t if t is None else pii.redacted(t, pii.all_spans(t, field)[1]) for i, t in was.items()}
            assert "<EMAIL>" in now[2000]
            assert all(r.n_chars == len(r.text or "") for r in after.collect())
        path = f"{tmp_path}/{name}"
        after.write.parquet(path)
        before = spark.read.parquet(path)
    last = corpus_pipeline.STAGES[-1][1](spark, before, str(tmp_path)).collect()
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in last) and len(last) == before.count()
    assert {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {(r.doc_id, tuple(r.ids)) for r in last}


def test_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated ids and rows, clashing extra columns, a very long text; then empty tables."""
    plain = "the river runs by the old stone under the garden wall and the miller walks along it each morning with his dog"
    rows = [
        (1, plain, "en"), (1, plain, "en"), (1, "another text under the same id, quite unlike the first one in all its words", "en"), (2, plain + " again", None), (None, plain, "fr"), (None, None, None), (3, None, "en"),
        (4, "", "de"), (5, " \n\t", "en"), (6, "word " * 60_000, "en"), (7, "mail me@here.org, mail me@here.org", "en"), (7, "mail me@here.org, mail me@here.org", "en"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, text_sha256 string, ids string, lossless int, label int, toxic int, h string, c string"
    docs = spark.createDataFrame([(i, t, g, "s", len(t or ""), "x", "y", 1, 2, 3, "z", None) for i, t, g in rows], schema)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "no such words are in any of the documents at all")], "item_id long, text string")
    for name, (d, l, b) in {"odd": (docs, labels, bench), "bare": (docs, labels.limit(0), bench.limit(0)), "empty": (docs.limit(0), labels, bench)}.items():
        at = f"{tmp_path}/{name}"
        for table, df in (("documents", d), ("labels", l), ("benchmark", b)):
            df.write.parquet(f"{at}/{table}.parquet")
        before = spark.read.parquet(f"{at}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            after = f(spark, before, at)
            assert after.columns == docs.columns and after.filter("text_sha256 <> 'x' OR ids <> 'y' OR label <> 2 OR h <> 'z' OR c IS NOT NULL").count() == 0, (name, stage)
            path = f"{at}/{stage}"
            after.write.parquet(path)
            before = spark.read.parquet(path)
        kept = before.collect()
        last = corpus_pipeline.STAGES[-1][1](spark, before, at).collect()
        assert len(last) == len(kept) and all(r.lossless for r in last)
        if name == "empty":
            assert kept == []
        if name == "bare":  # nothing is toxic or in the benchmark: all but near copies of smaller ids stay
            assert sorted((r.doc_id or 0, (r.text or "")[:9]) for r in kept) == sorted(
                [(1, "the river"), (1, "the river"), (1, "another t"), (0, "the river"), (0, ""), (3, ""), (4, ""), (5, " \n\t"), (6, "word word"), (7, "mail <EMA"), (7, "mail <EMA")]
            )
