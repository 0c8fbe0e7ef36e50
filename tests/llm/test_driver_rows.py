"""What grows with the texts stays out of the driver, however small Spark takes it to be."""

import random

from nightsieve.llm import simhash


def test_simhash_broadcasts_no_table_that_grows_with_the_texts(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{rng.randrange(300)}" for _ in range(400)]
    texts = [" ".join(words[:k] + ["other"] + words[k + 1:]) for k in range(0, 400, 10)] + [f"{k} {k * k} v{k}" for k in range(20)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = sorted(tuple(r) for r in simhash.near_duplicates(df, width=3, busy=1 << 40).collect())
    plans = {}

    def run(rows, name):
        got = rows.collect()
        plans[name] = rows._jdf.queryExecution().executedPlan().toString()
        return got

    def staged(rows, name, real=simhash.staged):
        run(rows, name)
        return real(rows, name)

    def components(ends, first, second, real=simhash.components):
        assert len(run(ends, "ends")) > 5
        return real(ends, first, second)

    monkeypatch.setattr(simhash, "staged", staged)
    monkeypatch.setattr(simhash, "components", components)
    got = run(simhash.near_duplicates(df, width=3), "result")
    assert {"anchors", "ends", "result"} <= plans.keys()
    assert all("Join" in plans[name] for name in ("anchors", "ends", "result"))  # the joins are seen at all
    assert [name for name, plan in plans.items() if "Broadcast" in plan] == []
    assert sorted(tuple(r) for r in got) == want and len({r.component_id for r in got}) < len(texts)
