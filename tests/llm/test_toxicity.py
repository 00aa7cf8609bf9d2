import pandas as pd
import pytest

from fathom.llm.queries import QUERIES
from fathom.llm.toxicity import Model, Scorer, drop_toxic, fit, fit_from_labels, grams, score_toxicity
from tests.llm.helpers import SF

INSULTS = "idiot moron worthless pathetic stupid clown trash loser scum disgusting".split()


def measured(d, got):
    """Recall and false positives against the labels; the English insults are known, so wrong labels there don't count."""
    insult = d.text.str.lower().str.contains("|".join(INSULTS))
    toxic, clean = insult | ((d.toxic == 1) & (d.lang != "en")), (d.toxic == 0) & ~insult
    return got[toxic].mean(), got[clean].mean()


@pytest.fixture(scope="module")
def halves():
    """A model of half of the labelled documents of sf0.1, and the others."""
    d = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id").drop_duplicates("text")
    train, test = d[d.doc_id % 2 == 0], d[d.doc_id % 2 == 1]
    train = pd.concat([train[train.toxic == 1], train[train.toxic == 0].head(700)])
    return fit(list(train.text), list(train.toxic), 2.5), test


def test_held_out(halves):
    model, test = halves
    recall, wrong = measured(test, Scorer(model).scores(list(test.text)) > model.threshold)
    assert recall > 0.9 and wrong < 0.01


def test_misspellings(halves):
    """Words that training never saw weigh like the ones they resemble, and a long text doesn't hide them."""
    model, _ = halves
    clean = "the ining of ander this tionre and edly with an hereas on that".split()
    weigh = lambda w: model.weight[grams(w)].mean()
    assert min(map(weigh, ("idiiot", "morron", "stupidd", "worthles", "patheticc", "clownn"))) > max(map(weigh, clean))
    s, long = Scorer(model), " ".join(clean * 1600)
    assert s.scores([long + " you idiot moron trash a scum that loser on clown is " + long])[0] > model.threshold > s.scores([long])[0]


def test_one_insult_repeated(halves):
    """A word counts once in every window, so repeating it through a long text scores like one window of it."""
    model, _ = halves
    s = Scorer(model)
    once, long = s.scores(["idiot idiot idiot idiot", "idiot " * 400])
    assert abs(once - long) < 1e-9


def test_edges(spark):
    model = fit_from_labels(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")))
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "...", 9), (4, "idiot moron scum", 9), (4, "idiot moron scum", 9), (None, "the and of", None)], "doc_id long, text string, Toxicity int")
    out = score_toxicity(df, model)
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].toxicity for i in (1, 2, 3)] == [0, 0, 0] and got[4].is_toxic and not got[None].is_toxic
    assert out.count() == 6 and [c.lower() for c in out.columns].count("toxicity") == 1
    left = drop_toxic(df, model)
    assert left.count() == 4 and left.schema == df.schema
    assert score_toxicity(df.limit(0), model).count() == 0
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert drop_toxic(df, fit_from_labels(df, empty)).count() == 6
    assert fit(["a", None, "b"], [1, 1, None]).threshold == Model.none().threshold


def test_query(spark):
    rows = QUERIES["op3_toxicity"](spark, SF).collect()
    d = pd.read_parquet(f"{SF}/documents.parquet")
    assert len(rows) == len(d)
    d = d.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    flag = {r.doc_id: r.is_toxic for r in rows}
    recall, wrong = measured(d, d.doc_id.map(flag))
    assert recall > 0.85 and wrong < 0.03
