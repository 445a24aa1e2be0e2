import numpy as np

from chronosift.llm import cotrain, queries
from tests.llm import helpers


def test_views_teach_each_other():
    rng = np.random.default_rng(3)
    n = 1500
    y = rng.integers(0, 2, n).astype(float)
    text = np.stack([y * 3 + rng.normal(size=n), rng.normal(size=n)], axis=1)
    meta = np.stack([y * 2 + rng.normal(size=n), rng.normal(size=n)], axis=1)
    few = 40
    model = cotrain.co_train(text[:few], meta[:few], y[:few], cotrain.array_pool(text[few:900], meta[few:900], 30))
    assert all(a > 0 and b > 0 for a, b in model.rounds) and len(model.rounds) == cotrain.ROUNDS
    z = model.text.margin(text[900:]) * model.both[0] + model.meta.margin(meta[900:]) * model.both[1] + model.both[2]
    both = ((z > 0) == (y[900:] > 0)).mean()
    alone = ((model.meta.margin(meta[900:]) > 0) == (y[900:] > 0)).mean()
    assert both > 0.93 and both > alone


def test_quality_on_data(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op2_quality_classifier(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert np.mean([rows[r.doc_id].kept == bool(r.quality) for r in labels if r.doc_id in rows]) > 0.95


def test_held_out_documents(spark):
    """Trained on half of the labels, judged on the other."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = cotrain.fit(docs, labels.filter("doc_id % 2 = 0"))
    got = cotrain.score(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.quality) for r in got]) > 0.93
    assert all(a > 0 and b > 0 for a, b in model.rounds)


def test_rounds_over_the_table_equal_brute_force(spark):
    """The surest documents of all tasks are those of all documents in one array, so that both ways give one model."""
    sf = helpers.SF
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").repartition(5), spark.read.parquet(f"{sf}/labels.parquet")
    prepared = cotrain.views(docs)
    model = cotrain.fit(docs, labels, each=7, prepared=prepared)
    marks = {r.doc_id: r.quality for r in labels.collect()}
    rows = sorted(prepared.collect(), key=lambda r: r.key)
    train = [r for r in rows if r.id in marks]
    rest = [r for r in rows if r.id not in marks]
    tv, mv, key = cotrain.text_views([r.tv for r in rest]), cotrain.meta_views([r.mv for r in rest]), np.array([r.key for r in rest])

    def surest(models, taken):
        out = {}
        for v in (0, 1):
            m = models[v].margin((tv, mv)[v])
            for good in (0, 1):
                order = sorted((i for i in range(len(rest)) if int(key[i]) not in taken[1 - v]), key=lambda i: (-m[i] if good else m[i], key[i]))
                out[v, good] = [(int(key[i]), tv[i], mv[i]) for i in order[:7]]
        return out

    want = cotrain.co_train(cotrain.text_views([r.tv for r in train]), cotrain.meta_views([r.mv for r in train]), np.array([float(marks[r.id]) for r in train]), surest)
    assert model.rounds == want.rounds and sum(map(sum, model.rounds)) > 0
    assert np.allclose(model.text.weights, want.text.weights) and np.allclose(model.meta.weights, want.meta.weights) and np.allclose(model.both, want.both)


def test_awkward_rows(spark):
    docs = helpers.clashing(spark)
    for rows in ([], [(1, 1), (2, 1)], [(1, 1), (9, 0), (8, 0), (None, 1), (777, 0), (5, None)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        got = cotrain.score(docs, cotrain.fit(docs, labels)).collect()
        assert len(got) == len(helpers.awkward_rows()) and all(0 <= r.score <= 1 for r in got)
        assert not rows or len({r.score for r in got if r.doc_id == 6}) == 1
    assert cotrain.score(helpers.empty(spark), 0.5).count() == 0
