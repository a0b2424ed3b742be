import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessergrid.llm import language_mix, toxicity_chain as X

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    report = X.toxicity_report(docs, labels, train_on=~language_mix.held_out(F.col("doc_id")))
    rows = report.join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").where("held_out").collect()
    bad = [r for r in rows if r.label == 1]
    good = [r for r in rows if r.label == 0]
    assert sum(r.toxic for r in bad) / len(bad) >= 0.8 and sum(r.toxic for r in good) / len(good) <= 0.01


def test_later_links_use_earlier_ones():
    rng = np.random.default_rng(0)
    texts = ["spite" if a else "calm" for a in rng.integers(0, 2, 400)]
    rows, buckets = X.word_buckets(pa.array(texts))
    y = np.array([[t == "spite", t == "spite"] for t in texts], int)
    chain = X.fit_chain(rows, buckets, y, np.ones(400), np.arange(400) % 4)
    assert len(chain[1].earlier) == 1 and chain[1].earlier[0] > 0
    p = X.score_texts(pa.array(["spite", "calm", None, "", "?!"]), chain)
    assert p[0].min() > 0.9 and p[1].max() < 0.1 and not p[2:].any()


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, int(i > 20)) for i in range(30)] + [(None, 1, 1), (5, None, 1), (6, 0, 1)], "doc_id bigint, quality int, toxic int")
    report = X.toxicity_report(odd, labels)
    assert report.count() == odd.count() and report.columns == ["doc_id", "held_out", "quality_prob", "toxic_prob", "toxic"]
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert X.toxicity_report(odd, none).where("toxic").count() == 0
    assert X.toxicity_report(odd.limit(0), labels).count() == 0


def dense_link(x, y, weight, before):
    """Ridge logistic regression by full matrices: words by z score, then Newton's method, then the intercept."""
    n, n1 = len(y), y.sum()
    kept = []
    for j in range(x.shape[1]):
        every, ones = x[:, j].sum(), x[y == 1, j].sum()
        rate = every / n
        spread = np.sqrt(max(rate * (1 - rate), 1e-12) * (1 / n1 + 1 / (n - n1)))
        if every >= 3 and abs(ones / n1 - (every - ones) / (n - n1)) / spread >= X.LEAST_Z:
            kept.append(j)
    full = np.column_stack([x[:, kept], before, np.ones(n)])
    ridge = np.diag([X.RIDGE] * (full.shape[1] - 1) + [1e-6])
    beta = np.zeros(full.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-full @ beta))
        beta += np.linalg.solve(full.T @ (full * np.maximum(p * (1 - p), 1e-6)[:, None]) + ridge, full.T @ (y - p) - ridge @ beta)
    shift = np.log((weight[y == 1].sum() / n1) / (weight[y == 0].sum() / (n - n1)))
    return lambda x, before: 1 / (1 + np.exp(-(np.column_stack([x[:, kept], before, np.ones(len(x))]) @ beta + shift)))


def test_same_as_full_matrices():
    rng = np.random.default_rng(1)
    n, vocab = 300, [f"w{i}" for i in range(40)]
    x = (rng.random((n, len(vocab))) < 0.2).astype(float)
    y = np.stack([rng.random(n) < 0.15 + 0.6 * x[:, 0], rng.random(n) < 0.1 + 0.4 * x[:, 1] + 0.4 * x[:, 0]], 1).astype(int)
    weight, fold = rng.uniform(0.5, 2, n), np.arange(n) % 4
    texts = pa.array([" ".join(w for w, has in zip(vocab, r, strict=True) if has) for r in x])
    chain = X.fit_chain(*X.word_buckets(texts), y, weight, fold)
    before, earlier, want = np.zeros((n, 0)), np.zeros((n, 0)), np.zeros((n, 0))
    for k in range(2):
        out = np.zeros(n)
        for f in range(4):
            kept = fold != f
            out[~kept] = dense_link(x[kept], y[kept, k], weight[kept], before[kept])(x[~kept], before[~kept])
        link = dense_link(x, y[:, k], weight, before)
        want = np.column_stack([want, link(x, earlier)])
        earlier, before = want, np.column_stack([before, out])
    want[x.sum(1) == 0] = 0
    assert np.abs(X.score_texts(texts, chain) - want).max() < 1e-4


def test_no_cap_on_features():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 2000)
    texts = [" ".join([f"{'t' if t else 'c'}{i}" for i in range(400) if rng.random() < 0.3] + ["same"]) for t in y]
    rows, buckets = X.word_buckets(pa.array(texts))
    assert len(X.fit_link(rows, buckets, y.astype(float), np.ones(2000), np.zeros((2000, 0))).features) == 800
