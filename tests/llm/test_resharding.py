import time
import zlib
from itertools import product

import numpy as np

from gale.llm.resharding import capacities, min_cost_flow, netted_flow, reshard
from tests.llm.conftest import frame


def brute_cost(supply, capacity, cost):
    """Least cost over all integral flows of a tiny network."""
    best = None
    cells = [(i, j) for i in range(len(supply)) for j in range(len(capacity))]
    for f in product(range(max(supply) + 1), repeat=len(cells)):
        m = np.zeros((len(supply), len(capacity)), int)
        for (i, j), x in zip(cells, f):
            m[i, j] = x
        if (m.sum(1) == supply).all() and (m.sum(0) == capacity).all():
            c = (m * cost).sum()
            best = c if best is None else min(best, c)
    return best


def test_flow_is_cheapest():
    rng = np.random.default_rng(4)
    for supply, capacity in (([3, 2], [1, 2, 2]), ([0, 4], [2, 2]), ([2, 1, 2], [3, 2])):
        for _ in range(3):
            cost = rng.integers(0, 5, (len(supply), len(capacity))).astype(float)
            flow = min_cost_flow(supply, capacity, cost)
            assert (flow.sum(1) == supply).all() and (flow.sum(0) == capacity).all() and (flow >= 0).all()
            assert (flow * cost).sum() == brute_cost(supply, capacity, cost)


def test_only_the_surplus_moves():
    rng = np.random.default_rng(5)
    supply = rng.integers(0, 10_000, 30).tolist()
    capacity = capacities(sum(supply), 40)
    cost = (np.arange(30)[:, None] != np.arange(40)[None, :]).astype(float)
    flow = min_cost_flow(supply, capacity, cost)
    assert (flow.sum(1) == supply).all() and (flow.sum(0) == capacity).all()
    assert (flow * cost).sum() == sum(max(0, s - c) for s, c in zip(supply, capacity))


def test_netted_flow_is_as_cheap_and_fast():
    rng = np.random.default_rng(6)
    for old, new in ((1, 1), (3, 7), (7, 3), (12, 12), (30, 40)):
        supply = rng.integers(0, 1000, old).tolist()
        room = capacities(sum(supply), new, rng.random(new) + 0.01)
        cost = (np.arange(old)[:, None] != np.arange(new)[None, :]).astype(float)
        a, b = netted_flow(supply, room), min_cost_flow(supply, room, cost)
        assert (a.sum(1) == supply).all() and (a.sum(0) == room).all() and (a >= 0).all()
        assert (a * cost).sum() == (b * cost).sum()
    supply = rng.integers(0, 10_000, 100_000).tolist()
    began = time.perf_counter()
    flow = netted_flow(supply, capacities(sum(supply), 40))
    assert time.perf_counter() - began < 10 and flow.sum() == sum(supply)


def test_blocks_are_bounded_in_bytes(spark):
    docs = frame(spark, [(i, "y" * 1000) for i in range(60)]).drop("old").selectExpr("*", "'a' as old")
    out = reshard(docs, "old", 3, block_bytes=5000)
    size = check(out, docs, 3)
    assert max(size.values()) - min(size.values()) <= 2 * 1016


def check(out, docs, shards, overhead=16):
    rows = out["rows"].collect()
    want = docs.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=str) == sorted(((r["doc_id"], r["text"]) for r in want), key=str)
    by, size = {}, {}
    for r in rows:
        s = r[out["shard_col"]]
        by.setdefault(s, []).append(r[out["slot_col"]])
        size[s] = size.get(s, 0) + len((r["text"] or "").encode()) + overhead
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))
    assert all(0 <= s < shards for s in by)
    return size


def test_shards_are_near_equal_and_complete(documents):
    docs = documents.selectExpr("*", "if(doc_id % 3 = 0, 'a', if(doc_id % 7 = 0, 'b', 'c')) as old")
    out = reshard(docs, "old", 5, block_rows=20)
    size = check(out, docs, 5)
    most = max(len(r["text"].encode()) for r in docs.collect()) + 16
    assert max(size.values()) - min(size.values()) <= 2 * most and len(size) == 5
    assert out["old"] == ["a", "b", "c"] and out["moved_bytes"] == out["flow"].sum() - sum(out["flow"][i, i] for i in range(3))


def test_unaffected_shards_stay(spark):
    docs = frame(spark, [(i, "x" * 84) for i in range(40)]).drop("old").selectExpr("*", "if(doc_id < 10, 'a', 'b') as old")
    out = reshard(docs, "old", 3, weights=[10, 15, 15], block_rows=4)
    assert out["affected"] == [1, 2]
    size = check(out, docs, 3)
    assert size == {0: 1000, 1: 1500, 2: 1500}
    stay = {r["doc_id"] for r in out["rows"].collect() if r[out["shard_col"]] == 0}
    assert stay == set(range(10))


def test_messy_and_empty(messy, nothing):
    out = reshard(messy, "old", 4, block_rows=3)
    check(out, messy, 4)
    assert set(messy.columns) - set(out["rows"].columns) == {"old"}
    assert reshard(nothing, "old", 4)["rows"].count() == 0


def test_query_digest(spark):
    from gale.llm.queries import op5_resharding
    rows = op5_resharding(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        b = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 16, zlib.crc32(b), "bytes", None)
