"""Grounding sends texts only to their candidates, and gives what it gave when it carried them along."""

from pyspark.sql import functions as F

from roamlens.operators import mentions


def test_no_row_carries_a_text_through_the_last_shuffle(spark):
    texts = spark.createDataFrame([(1, "We saw Old Fort. The old  fort is big! কোথায় যাব"), (2, None), (3, "nothing")], "review_id long, review_text string")
    rows = [(1, 1, "Old Fort", "place", None, None), (1, 2, "OLD FORT", "PLACE", None, None), (1, 3, "Old Fort", "PLACE", 7, 15), (1, 4, "Old Fort", "PLACE", 0, 8), (1, 5, " ", "PLACE", None, None),
            (1, 6, "fort", "SNACK", None, None), (1, 7, "We", "TIP", 5, 2), (2, 1, "x", "PLACE", None, None), (9, 1, "y", "PLACE", None, None)]
    c = spark.createDataFrame(rows, "review_id long, cand_no long, surface string, entity_type string, start int, end int").withColumn("confidence", F.lit(None).cast("double"))
    got = mentions.ground(c, texts)
    seen = {(r.review_id, r.cand_no): (r.surface, r.start, r.end, r.match_kind, r.sentence, r.drop_reason) for r in got.collect()}
    assert seen[1, 1] == ("Old Fort", 7, 15, "exact", "We saw Old Fort.", None)
    assert seen[1, 2] == ("old  fort", 21, 30, "whitespace", "The old fort is big!", None)
    assert seen[1, 3] == ("Old Fort", None, None, None, None, "duplicate-span")
    assert [seen[1, k][-1] for k in (4, 5, 6, 7)] == ["offsets-do-not-hold-surface", "empty-surface", "unknown-type:SNACK", "offsets-out-of-range"]
    assert seen[2, 1][-1] == seen[9, 1][-1] == "not-in-source"
    node = got._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Window":
        node = node.children().head()
    assert not {"review_text", "body"} & set(node.output().mkString(",").replace("#", ",").split(","))
