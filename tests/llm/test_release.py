"""What one stage leaves behind in the memory of executors and workers."""

import corpus_pipeline
from siftline.llm import common, words


def full_collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())


def test_executors_give_back_their_heap(spark):
    before = full_collections(spark)
    common.release(spark)
    assert full_collections(spark) > before


def test_each_stage_begins_with_it(spark, monkeypatch):
    said = []
    monkeypatch.setattr(corpus_pipeline, "release", lambda s: said.append("release"))
    for _, stage in corpus_pipeline.STAGES:
        corpus_pipeline.fresh(lambda *a: said.append("stage"))(spark, None, "")
        assert stage.__wrapped__ and said == ["release", "stage"]
        said.clear()


def test_workers_give_back_their_memory(monkeypatch):
    said = []
    monkeypatch.setattr(words, "trim", lambda: said.append(1))
    cache = words.WordCache(lambda w: w)
    words.sole(cache).all([b"a"])
    said.clear()
    words.forget()
    assert said == [1] and not cache.young and not words._current
    monkeypatch.undo()
    words.trim()
