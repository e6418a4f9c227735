import time

from tessera import durable


def test_each_cut_releases_what_nothing_refers_to(spark, monkeypatch):
    collected = []
    monkeypatch.setattr(durable.gc, "collect", lambda: collected.append(1))
    for _ in range(2):
        assert durable.cut(spark.range(3)).count() == 3
    assert len(collected) == 2


def test_garbage_goes_while_a_long_cut_is_written(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(durable, "RELEASE_SECONDS", 0.2)
    monkeypatch.setattr(durable, "release", lambda session: calls.append(session))

    def slow(batches):
        for pdf in batches:
            time.sleep(1.5)
            yield pdf

    assert durable.cut(spark.range(0, 4, 1, 4).mapInPandas(slow, "id long")).count() == 4
    assert len(calls) >= 4 and set(calls) == {spark}
