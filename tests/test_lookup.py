import json
import os
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F

from quarry.operators import lookup as L
from quarry.operators.memo import Memo

HIT, MISS = {"collection": [{"@id": "http://x/abc"}, {"@id": "http://x/12"}]}, {"collection": [{"@id": "http://x/abc"}]}


class Clock:
    """Time that passes only where something sleeps or a call takes long."""

    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds


def asked(script, config=L.LookupConfig(), takes=0.0):
    """(status, tries, waits) of a client that raises or gives what the script says."""
    clock, left = Clock(), list(script)

    def client(query, limit):
        clock.now += min(takes, limit)
        step = left.pop(0)
        if isinstance(step, Exception):
            raise step
        return step

    return (*L.look_up_once(client, "q", config, sleep=clock.sleep, clock=clock), clock.slept)


def test_every_status():
    fail = L.LookupFailure
    assert asked([HIT]) == (L.FOUND, 1, [])
    assert asked([MISS]) == asked([{}]) == asked([[]]) == asked([{"collection": None}]) == (L.ABSENT, 1, [])
    assert asked([fail(429), fail(503), HIT]) == (L.FOUND, 3, [5.0, 10.0])
    assert asked([fail(429)] * 3) == (L.THROTTLED, 3, [5.0, 10.0])
    assert asked([fail(500)] * 3) == (L.UNREACHABLE, 3, [5.0, 10.0])
    assert asked([fail(404)]) == (L.REFUSED, 1, [])
    assert asked([ValueError(), json.JSONDecodeError("x", "y", 0), ValueError()]) == (L.UNREADABLE, 3, [5.0, 10.0])
    assert asked([TimeoutError(), ConnectionError(), OSError()]) == (L.UNREACHABLE, 3, [5.0, 10.0])
    assert asked([fail(429), MISS]) == (L.ABSENT, 2, [5.0])


def test_the_deadline_ends_waits_and_limits_calls():
    assert asked([L.LookupFailure(429)] * 3, L.LookupConfig(deadline=12.0)) == (L.LATE, 2, [5.0])
    assert asked([L.LookupFailure(429)], L.LookupConfig(deadline=4.0)) == (L.LATE, 1, [])
    assert asked([TimeoutError()] * 3, L.LookupConfig(deadline=100.0), takes=60.0) == (L.UNREACHABLE, 3, [5.0, 10.0])


class Planned:
    """A client that notes its calls in a shared folder and fails as the query says."""

    def __init__(self, folder):
        self.folder = folder
        self.lock, self.running, self.most = threading.Lock(), 0, 0

    def __call__(self, query, limit):
        with self.lock:
            self.running += 1
            self.most = max(self.most, self.running)
        time.sleep(0.01)
        with self.lock:
            self.running -= 1
        open(f"{self.folder}/{query}-{self.most}-{uuid.uuid4().hex}", "w").close()
        if query.startswith("down") and not os.path.exists(f"{self.folder}/up"):
            raise L.LookupFailure(503)
        if query.startswith("bad"):
            raise L.LookupFailure(400)
        return HIT if query.startswith("hit") else MISS


def calls(folder):
    return sorted(f.rsplit("-", 2)[0] for f in os.listdir(folder) if f != "up")


def test_lookups_of_rows(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(1, "hit a"), (2, "miss"), (3, None), (4, " "), (5, "bad"), (6, "down"), *((i, "hit a") for i in range(10, 200))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "k long, term string, key string").repartition(3)
    memo, config = Memo(spark, f"{tmp_path}-memo", "v"), L.LookupConfig(first_wait=0.0, concurrent=2, tasks=2)
    make = lambda: Planned(folder)
    got = {r.k: (r.found, r.lookup_status) for r in L.lookup(df, "term", make, memo, config).collect()}
    assert got[1] == got[150] == (1, "found") and got[2] == got[3] == got[4] == (0, "absent") and got[5] == (0, "refused") and got[6] == (0, "unreachable")
    assert len(got) == len(rows) and calls(folder) == ["bad", "down", "down", "down", "hit a", "miss"]
    # Again: only what failed is asked, and what was repaired is found.
    open(f"{folder}/up", "w").close()
    got = {r.k: (r.found, r.lookup_status) for r in L.lookup(df, "term", make, memo, config).collect()}
    assert got[6] == (0, "absent") and got[1] == (1, "found") and calls(folder) == sorted(["bad"] * 2 + ["down"] * 4 + ["hit a", "miss"])
    assert L.lookup(df.limit(0), "term", make, memo, config).count() == 0


def test_calls_at_once_are_bounded(spark, tmp_path):
    df = spark.createDataFrame([(f"miss {i}",) for i in range(60)], "key string")
    assert L.statuses(df, lambda: Planned(str(tmp_path)), L.LookupConfig(concurrent=3, tasks=2)).count() == 60
    assert max(int(f.rsplit("-", 2)[1]) for f in os.listdir(tmp_path)) <= 3


def asks(folder, fails=()):
    """Notes the keys that are asked; the slice with a failing key is killed before any of it is stored."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keys = b.column("key").to_pylist()
            for k in keys:
                if k in fails:
                    raise RuntimeError("killed")
                open(f"{folder}/{k}-{uuid.uuid4().hex}", "w").close()
            yield pa.RecordBatch.from_pydict({"key": keys, "answer": [None if k.endswith("7") else f"a {k}" for k in keys]})

    return lambda rows: rows.select("key").coalesce(1).mapInArrow(run, "key string, answer string")


def test_a_killed_run_asks_only_for_the_rest(spark, tmp_path):
    folder, store = str(tmp_path), f"{tmp_path}-memo"
    items = spark.createDataFrame([(f"k{i % 40}", i) for i in range(120)] + [(None, 1)], "key string, i long")
    memo = Memo(spark, store, "v1")
    with pytest.raises(Exception, match="killed"):
        memo.answers(items, asks(folder, {"k23"}))
    stored = {r.key for r in memo.known().collect()}
    assert 0 < len(stored) < 39
    for f in os.listdir(folder):
        os.remove(f"{folder}/{f}")
    got = memo.answers(items, asks(folder)).collect()
    assert len(got) == 121 and {(r.key, r.answer) for r in got} == {(f"k{i}", None if i % 10 == 7 else f"a k{i}") for i in range(40)} | {(None, None)}
    assert sorted({f.rsplit("-", 1)[0] for f in os.listdir(folder)}) == sorted({f"k{i}" for i in range(40)} - stored)
    for f in os.listdir(folder):
        os.remove(f"{folder}/{f}")
    memo.answers(items, asks(folder))
    assert sorted({f.rsplit("-", 1)[0] for f in os.listdir(folder)}) == ["k17", "k27", "k37", "k7"]  # failures aren't stored


def test_one_winner_a_key_and_version(spark, tmp_path):
    memo, other = Memo(spark, f"{tmp_path}/m", "v1"), Memo(spark, f"{tmp_path}/m", "v2")
    assert memo.known().count() == 0
    rows = lambda *x: spark.createDataFrame(x, "key string, answer string")
    memo.add(rows(("a", "first"), ("b", None), (None, "x")))
    memo.add(rows(("a", "second"), ("c", "z"), ("c", "y")))
    memo.add(rows(("a", "first")))
    other.add(rows(("a", "other")))
    assert sorted(map(tuple, memo.known().collect())) == [("a", "first"), ("c", "y")] and [tuple(r) for r in other.known().collect()] == [("a", "other")]
    left = memo.missing(spark.createDataFrame([("a", 1), ("b", 2), ("b", 1), (None, 1)], "key string, n int")).collect()
    assert [tuple(r) for r in left] == [("b", 1)]
    plan = memo.missing(rows(("a", "x"))).withColumn("n", F.lit(1))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan
