"""op8: grammar, edges and held-out accuracy."""

from hypothesis import given
from hypothesis import strategies as st

from viewspan.llm import toxicity as X


def test_grammar():
    m = X.Model({"idiot": 2.0}, [0.0] * X.FEATURES, [1.0] * X.FEATURES, [1.0] + [0.0] * (X.FEATURES - 1), -1.0)
    one = lambda t: m.clauses(t)[0]
    assert one("what an idiot that is.") == [(2.0, 1, 0, 0)]
    assert one("you are an idiots.") == [(3.0, 0, 1, 0)]
    assert one("not an idiot.") == [(0.6, 0, 0, 1)]
    assert one("the man said idiot.") == [(1.0, 0, 0, 1)]
    assert one("never not an idiot") == [(2.0, 1, 0, 0)]  # the second negation undoes the first
    assert one("he said no. an idiot") == [(2.0, 1, 0, 0)]  # neither reaches over the clause's end
    assert one("kill") == [(X.THREAT_WEIGHT, 1, 0, 0)] and one("i will surely kill you") == one("going to be killing") == [(2 * X.THREAT_WEIGHT, 1, 0, 0)]
    assert one("you idiot. a fine day! idiot") == [(3.0, 0, 1, 0), (2.0, 1, 0, 0)]
    assert one("what a day.") == one("") == one(None) == []
    assert m.clauses("a. b.. c")[1:] == (3, 6) and m.features(None) == [0.0] * X.FEATURES
    assert m.scores(["idiot"]) > m.scores(["not an idiot"]) > m.scores(["a day"])
    a = X.Transducer({("0", "x"): ("1", "y", 2.0)}, default={"1": "0"})
    b = X.Transducer({("0", "y"): ("0", "z", 3.0)})
    assert a.compose(b, ["x"]).step("0|0", "x") == ("1|0", "z", 6.0)


@given(st.sets(st.text("ab", min_size=1, max_size=4), max_size=6), st.sets(st.text("ab", min_size=1, max_size=4), max_size=4), st.text("abc", max_size=7))
def test_lexicon(beginnings, words, w):
    """Against plain look-ups: a whole word, else the longest beginning."""
    begins, whole = {b: (f"B{b}", 1.0) for b in beginnings}, {x: (f"W{x}", 2.0) for x in words}
    machine = X.lexicon(begins, whole)
    state = machine.start
    for c in w:
        state = machine.step(state, c)[0]
    longest = next((w[:k] for k in range(len(w), 0, -1) if w[:k] in begins), None)
    assert machine.step(state, "#") == ("", *(whole.get(w) or begins.get(longest, ("WORD", 1.0))))


def accuracy(df, labels):
    rows = df.join(labels.groupBy("doc_id").agg({"toxic": "max"}).withColumnRenamed("max(toxic)", "toxic"), "doc_id").where("held_out").collect()
    tp = sum(r["predicted"] == 1 == r["toxic"] for r in rows)
    return tp / max(1, sum(r["toxic"] for r in rows)), tp / max(1, sum(r["predicted"] for r in rows)), len(rows)


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    recall, precision, n = accuracy(X.op8_toxicity(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))
    assert n > 500 and recall > 0.9 and precision > 0.9, (recall, precision)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "x " * 50_000), (3, "x"), (None, "idiot")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    for lab in (labels, labels.limit(0), labels.where("toxic = 0")):
        out = X.toxicity(df, lab).collect()
        assert len(out) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert X.toxicity(df.limit(0), labels).count() == 0
