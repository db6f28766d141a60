"""Scratch tables: whole, and written without a process for each file."""

from pathlib import Path

from siftline.llm import common


def test_no_process_for_each_file(spark):
    """Each part had a checksum file, and each of both a chmod process, a child of the JVM with all its memory."""
    old = Path(common.scratch_root(spark).removeprefix("file://"), "siftline")
    before = set(old.glob("*-plain"))
    back = common.materialize(spark.range(0, 1000, 1, 7), "plain")
    path, = set(old.glob("*-plain")) - before
    assert sorted(r.id for r in back.collect()) == list(range(1000))
    assert len(list(path.glob("part-*"))) == 7 and not list(path.glob(".*"))


def test_other_tables_keep_their_checksums(spark, tmp_path):
    """Only the scratch tables are written so."""
    common.materialize(spark.range(10), "plain")
    spark.range(10).write.parquet(f"{tmp_path}/t")
    assert list((tmp_path / "t").glob(".*.crc"))


def test_a_worker_keeps_no_words_of_an_earlier_stage():
    """The words of the toxicity stage, and the models that they hang on, stayed in the workers while the next stage ran."""
    import gc
    import weakref

    import numpy as np

    from siftline.llm import words

    cache = words.sole(words.WordCache(lambda found: [np.zeros(1000) for _ in found]))
    cache.all(["a", "b"])
    left = weakref.ref(cache)
    del cache
    words.forget()
    gc.collect()
    assert left() is None and words._current == []
    kept = words.sole(words.WordCache(lambda found: [w.upper() for w in found]))
    assert kept.all(["a"]) == ["A"]
    words.forget()
    assert kept.all(["a", "b"]) == ["A", "B"]


def test_scoring_lets_its_models_go(spark):
    """Each task has models of its own; they stayed until another stage put a cache in their place."""
    import numpy as np
    import pyarrow as pa

    from siftline.llm import toxicity

    odds = toxicity.Odds.of(np.zeros((2, 1 << toxicity.GRAM_BITS), "f4"), np.zeros((2, 1 << toxicity.WORD_BITS), "f4"), np.ones(2))
    model = toxicity.Model([odds], 1.0, 1.0, 0.0, 1.0)

    def held(batches):
        from siftline.llm import words

        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([len(words._current)], pa.int64())], ["n", "held"])

    docs = spark.range(20).selectExpr("id AS doc_id", "concat('some words ', id) AS text").coalesce(1)
    assert toxicity.scored(docs, model, "doc_id").count() == 20
    rows = spark.range(0, 64, 1, 64).mapInArrow(held, "n long, held long").collect()
    assert sum(r.n for r in rows) == 64 and not any(r.held for r in rows)
