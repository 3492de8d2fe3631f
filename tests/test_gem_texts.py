"""Words of equal texts are cut once."""

from roamlens.operators import gems
from roamlens.session import broadcast_if_measured


def test_equal_texts_are_cut_into_words_once(spark, monkeypatch):
    plans = []

    def keep(df, *args):
        if "idf" in df.columns:
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return broadcast_if_measured(df, *args)

    monkeypatch.setattr(gems, "broadcast_if_measured", keep)
    m = spark.range(40).selectExpr("concat('m', id) AS mention_id", "'e' AS entity_id", "concat('r', id % 4) AS review_id", "'red boat red' AS sentence")
    r = spark.range(4).selectExpr("concat('r', id) AS review_id", "concat('p', id % 2) AS place_name", "'red hill' AS review_text")
    got = gems.term_distinct(m, r, []).collect()
    below = plans[0].split("Generate", 1)[1]
    assert "Aggregate [text" in below
    # n = 44; red in all texts, boat in 40, hill in 4
    from math import log, sqrt
    red, boat, hill = 1.0, log(45 / 41) + 1, log(45 / 5) + 1
    a = (1 + log(2)) * red
    want = 1 - a * red / sqrt(a * a + boat * boat) / sqrt(red * red + hill * hill)
    assert len(got) == 1 and abs(got[0].term_distinct - want) < 1e-9
