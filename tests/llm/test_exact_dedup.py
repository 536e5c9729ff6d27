import hashlib
from collections import defaultdict

from gale.llm.common import Scratch
from gale.llm.exact_dedup import build_index, directory, drop_copies, exact_dedup


def norm(t):
    return (t or "").encode().lower()


def test_every_row_gets_its_group(messy):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    want = sorted(((i, max([x for x in groups[norm(t)] if x is not None], default=None), len(groups[norm(t)]),
                    hashlib.sha256(norm(t)).hexdigest()) for i, t in rows), key=str)
    got = exact_dedup(messy, bucket_rows=3).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    kept = defaultdict(int)
    for r in got:
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert len(kept) == len(groups) and set(kept.values()) == {1}


def test_drop_copies_keeps_columns_and_one_row_a_text(messy, nothing):
    out = drop_copies(messy, bucket_rows=3)
    assert out.columns == messy.columns
    texts = [norm(r["text"]) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({norm(r["text"]) for r in messy.collect()})
    assert drop_copies(nothing).columns == nothing.columns and drop_copies(nothing).count() == 0
    assert exact_dedup(nothing).count() == 0


def test_buckets_split_until_they_fit(spark, documents):
    scratch = Scratch(spark, "test")
    index = build_index(documents, scratch, bucket_rows=20)
    sizes = {(r["local_depth"], r["bucket"]): r["count"] for r in index.groupBy("local_depth", "bucket").count().collect()}
    assert max(sizes.values()) <= 20 and len(sizes) > 4
    # buckets are disjoint ranges of the hash's leading bits
    for depth, b in sizes:
        assert not any((d, b >> (depth - d)) in sizes for d in range(depth))
    for r in index.collect():
        assert (r["h"] & (2 ** 64 - 1)) >> (64 - r["local_depth"]) == r["bucket"] if r["local_depth"] else True


def test_colliding_hashes_share_a_bucket(spark):
    same = spark.createDataFrame([(5, "a", 1), (5, "b", 1), (5, "c", 1)], "h long, sha string, keep_id long")
    cells = directory(same, bucket_rows=1, max_depth=4).collect()
    assert [r["local_depth"] for r in cells] == [4]  # cannot be split: one chain
