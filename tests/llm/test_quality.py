import zlib

import numpy as np

from gale.llm.quality import Buckets, index_vectors, keep_quality, pool, probabilities, quality_scores, train
from tests.llm.conftest import frame

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_scores(docs, labels).toPandas()
    assert len(got) == docs.count()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    assert ((got["score"] >= 0) & (got["score"] <= 1)).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    held = both[both["held_out"]]
    assert auc(held["quality"].to_numpy(), held["score"].to_numpy()) > 0.95
    assert (held["quality"] == held["predicted"]).mean() > 0.93


def test_only_allowed_labels_matter(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(string(doc_id)) % 3 = 1, 1 - quality, quality) as quality")
    a, b = ({r["doc_id"]: r["score"] for r in quality_scores(documents, x).collect()} for x in (labels, flipped))
    assert a == b


def test_messy(spark, messy, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (4, 1), (4, 0), (5, 1), (6, 0), (8, 1), (9, 0),
                                    (10, 1), (10, 1), (99, 1)], "doc_id long, quality int")
    got = quality_scores(messy, labels).collect()
    assert len(got) == messy.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality_scores(nothing, labels).count() == 0
    none = {r["score"] for r in quality_scores(messy, labels.limit(0)).collect()}
    assert none == {0.5}
    kept = keep_quality(messy, labels)
    assert kept.columns == messy.columns
    assert kept.count() == sum(r["predicted"] for r in got)
    assert keep_quality(frame(spark, []), labels.limit(0)).count() == 0


def test_pooling_and_training():
    place, sign = index_vectors(64)
    assert all(len(set(p)) == 4 for p in place) and set(np.unique(sign)) == {-1.0, 1.0}
    ids = Buckets(64)
    assert ids.of("Word WORD word, 12 34")[0] == ids.of("word")[0]
    assert not pool(None, ids, np.ones((64, 128), np.float32)).any()
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # needs the hidden layer
    model = train(x, y, np.arange(600) % 5 == 0, hidden=16, epochs=200)
    z = rng.normal(size=(300, 5))
    assert ((probabilities(model, z) > 0.5) == (z[:, 0] * z[:, 1] > 0)).mean() > 0.85
    assert probabilities(train(x, np.ones(600), np.zeros(600, bool)), x).tolist() == [1.0] * 600
