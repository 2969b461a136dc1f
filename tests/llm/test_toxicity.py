import numpy as np
import pytest
from test_gam import auc

from fluxframe.llm import toxicity as tox

SF = "/root/testdata/{}"


@pytest.mark.parametrize("sf,least", [("sf0.01", 0.9), ("sf0.1", 0.97)])
def test_held_out_accuracy(spark, sf, least):
    got = {r.doc_id: r for r in tox.toxicity_query(spark, SF.format(sf)).collect()}
    held = [r for r in spark.read.parquet(f"{SF.format(sf)}/labels.parquet").collect() if got[r.doc_id].held_out]
    y, s = np.array([r.toxic for r in held]), np.array([got[r.doc_id].score for r in held])
    p = np.array([got[r.doc_id].predicted for r in held])
    print(sf, auc(y, s), (p == y).mean(), p[y == 1].mean(), p[y == 0].mean())
    assert auc(y, s) > least - 0.05 and (p == y).mean() > least


def total(text, weights=None):
    return sum(tox.clause_scores(text, tox.Lexicon(weights or {"idiot": 2.0, "clow*": 1.0}), tox.compose())[0])


def test_grammar():
    assert total("the idiot") == 2.0 and total("clowns") == 1.0 and total("clow") == 0
    assert total("you are an idiot") == pytest.approx(2.0 * tox.AIMED)
    assert total("he is not an idiot") == pytest.approx(2.0 * tox.NEGATED)
    assert total("not here at all, the idiot") == 2.0  # the negation is too far
    assert total("they said idiot") == pytest.approx(2.0 * tox.REPORTED)
    assert total("they said so. idiot") == 2.0  # another clause
    assert total("'idiot', he said") == pytest.approx(2.0 * tox.REPORTED) and total("'You idiot!' he said. clowns") == pytest.approx(2.0 * tox.REPORTED * tox.AIMED + 1.0)
    assert total("idiot clowns") == 2.5  # the second of a row counts half
    assert total("I will not hurt you") == total("I will never hurt you, I promise") == total("I won't hurt you") == 0
    assert total("I know we will see how it can hurt when you go") == 0
    assert total("ich werde dich töten") == total("je vais te frapper") == total("I will really hurt you") == total("we are going to kill you") == tox.THREAT
    assert total("he said I will hurt you") == total("I will hurt you, she said") == tox.THREAT * tox.REPORTED
    assert total("I will hurt you") == tox.THREAT and total("you will hurt. I") == 0
    assert total("") == 0 and total("plain words only") == 0


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "idiot"), (3, "idiot"), (None, "x"), (5, "word " * 200_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id int, text string, score int")
    labels = spark.createDataFrame([(1, 1), (3, 1), (5, 0), (None, 1), (2, None)], "doc_id int, toxic int")
    assert all(0 <= r.score <= 1 for r in tox.classify(docs, tox.train(docs, labels)).collect())
    assert tox.classify(docs.limit(0), tox.train(docs.limit(0), labels.limit(0))).count() == 0


def test_whole_table_agrees_with_transducers_run_one_by_one(spark):
    docs = spark.read.parquet(SF.format("sf0.01") + "/documents.parquet")
    model = tox.train(docs, spark.read.parquet(SF.format("sf0.01") + "/labels.parquet"))
    got = {r.doc_id: (r.score, r.n_clauses) for r in tox.classify(docs, model).collect()}
    lexicon = tox.Lexicon(model.weights)
    for d in docs.collect():
        tokens = [lexicon.symbol(t) for t in tox._TOKENS.findall((d.text or "").lower())]
        scores, at = [], {n: t.start for n, t in tox.TRANSDUCERS.items()}
        held = 0.0
        for symbol, weight in [*tokens, (tox.END, 0.0)]:
            if symbol == tox.INSULT:
                held += weight * (tox.NEGATED if at["negation"] else 1) * (tox.AGAIN if at["insult"] else 1)
            if symbol == tox.END:
                total = (held * (tox.AIMED if at["target"] else 1) + tox.THREAT * (at["threat"] == (5, 0))) * (tox.REPORTED if at["report"] else 1)
                scores += [total] if total else []
                at, held = {n: t.start for n, t in tox.TRANSDUCERS.items()}, 0.0
            else:
                at = {n: t.step(at[n], symbol) for n, t in tox.TRANSDUCERS.items()}
        want = model.score([tox._inputs(scores, len(tokens))])[0]
        assert got[d.doc_id][1] == len(scores) and abs(got[d.doc_id][0] - want) < 1e-9
