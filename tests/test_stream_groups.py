"""Groups of a stream of file events against the same events at once."""

import random

import pytest
from helpers import rows

from twinsieve.streaming import groups as sg


def random_events(seed, paths=25, n=120):
    rng, out = random.Random(seed), []
    for _ in range(n):
        removed = rng.random() < 0.25
        size = rng.choice([0, 1, 2])
        out.append((f"/f{rng.randrange(paths)}", rng.randrange(30), removed, None if removed else size, None if removed or rng.random() < 0.05 else f"h{size}{rng.randrange(2)}"))
    return out + [out[0], out[1], (None, 3, False, 1, "h10"), ("/null", None, False, 1, "h10"), ("/unsure", 1, None, 1, "h10")]


def put(spark, events, folder, at):
    spark.createDataFrame(events, sg.EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def follow(spark, folder):
    q = sg.keep_groups(spark.readStream.schema(sg.EVENT).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint")
    q.awaitTermination()
    assert q.exception() is None


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_batches_comes_to_the_same(spark, tmp_path, seed):
    events = random_events(seed)
    want = rows(sg.groups_of_events(spark.createDataFrame(events, sg.EVENT)))
    random.Random(seed + 100).shuffle(events)
    for k in range(3):  # each round starts the query again from its checkpoint
        put(spark, events[k::3], tmp_path, k)
        follow(spark, tmp_path)
        seen = [e for j in range(k + 1) for e in events[j::3]]
        assert rows(sg.groups_now(spark, str(tmp_path / "out"))) == rows(sg.groups_of_events(spark.createDataFrame(seen, sg.EVENT)))
    assert rows(sg.groups_now(spark, str(tmp_path / "out"))) == want and want


def test_a_group_that_falls_to_one_member_is_retracted(spark, tmp_path):
    steps = [
        ([("/a", 1, False, 5, "h"), ("/b", 1, False, 5, "h"), ("/c", 1, False, 5, "h")], [(5, "h", 3, 10)]),
        ([("/c", 2, True, None, None)], [(5, "h", 2, 5)]),
        ([("/c", 1, False, 5, "h")], []),  # older than the removal
        ([("/b", 2, False, 7, "g")], [(5, "h", 1, 0)]),
        ([("/b", 3, False, 5, "h"), ("/c", 3, False, 5, "h")], [(5, "h", 3, 10)]),
    ]
    for k, (events, want) in enumerate(steps):
        put(spark, events, tmp_path, k)
        follow(spark, tmp_path)
        changes = spark.read.schema(sg.CHANGE + ", batch long").option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
        assert rows(changes.where(f"batch = {k}").drop("batch")) == want
    assert rows(sg.groups_now(spark, str(tmp_path / "out"))) == [(5, "h", 3, 10)]


def test_no_events(spark):
    assert rows(sg.groups_of_events(spark.createDataFrame([], sg.EVENT))) == []


class Held:
    """A handle whose states are maps in memory; `calls` counts what would go to the JVM."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getMapState(self, *named):
        return self

    def exists(self):
        self.calls += 1
        return bool(self.held)

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def removeKey(self, key):
        self.calls += 1
        self.held.pop(key, None)


def test_many_paths_and_groups_share_a_call_and_its_frames():
    import pandas as pd

    paths, groups = sg._processors(None)
    latest, count = Held(), Held()
    paths.init(latest)
    groups.init(count)
    columns = ["canonical_path", "version", "removed", "file_size", "content_hash"]
    n = 3000
    steps = [  # (version, removed, hash of path i), state calls by path and by group, changed groups
        ((1, False, lambda i: f"h{i // 3}"), 1 + n, 1 + n // 3, n // 3),  # nothing is known yet: no reads
        ((1, False, lambda i: f"h{i // 3}"), 1 + n, 0, 0),  # the same again: no writes
        ((2, True, lambda i: None), 1 + 2 * n, 1 + 2 * (n // 3), n // 3),
    ]
    for (version, removed, h), by_path, by_group, changed in steps:
        latest.calls = count.calls = 0
        events = pd.DataFrame([(f"/{i}", version, removed, 0 if removed else 5, h(i)) for i in range(n)], columns=columns)
        (moves,) = paths.handleInputRows((0,), iter([events]), None)
        assert latest.calls == by_path
        assert len(moves) == changed  # moves of a group are summed
        if len(moves):
            (changes,) = groups.handleInputRows((0,), iter([moves]), None)
            assert (count.calls, len(changes)) == (by_group, changed)
    assert not count.held


def test_keys_are_no_more_than_the_buckets(spark, tmp_path):
    events = [(f"/f{i}", 1, False, i // 2 + 1, f"h{i // 2}") for i in range(3000)]
    put(spark, events, tmp_path, 0)
    follow(spark, tmp_path)
    assert rows(sg.groups_now(spark, str(tmp_path / "out"))) == rows(sg.groups_of_events(spark.createDataFrame(events, sg.EVENT)))
    for store in (0, 1):
        state = spark.read.format("statestore").option("operatorId", store).option("stateVarName", ("latest", "count")[1 - store]).load(str(tmp_path / "checkpoint"))
        assert state.select("key").distinct().count() <= 1024 < state.count()


def test_sizes_beside_nulls_stay_whole(spark, tmp_path):
    big = 2**53 + 1
    put(spark, [("/a", 1, False, big, "h"), ("/a", 0, True, None, None), ("/b", 1, False, big, "h"), ("/b", 0, True, None, None)], tmp_path, 0)
    follow(spark, tmp_path)
    assert rows(sg.groups_now(spark, str(tmp_path / "out"))) == [(big, "h", 2, big)]


@pytest.mark.parametrize("turn", [1, -1])
def test_an_empty_hash_beats_none_in_any_order(spark, tmp_path, turn):
    events = [("/a", 1, False, 5, None), ("/a", 1, False, 5, ""), ("/b", 1, False, 5, "")][::turn]
    put(spark, events, tmp_path, 0)
    follow(spark, tmp_path)
    want = rows(sg.groups_of_events(spark.createDataFrame(events, sg.EVENT)))
    assert rows(sg.groups_now(spark, str(tmp_path / "out"))) == want == [(5, "", 2, 5)]
