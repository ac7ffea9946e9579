from loomtext.operators import graph


def test_no_mention_of_a_dense_line_is_dropped(spark):
    docs = spark.createDataFrame([("d", " ".join(f"TCK-{10000 + k}" for k in range(150)))], "doc_id string, text string")
    assert graph.mentions(docs).where("entity_type = 'identifier'").count() == 150
    assert graph.mentions(docs, 128).count() == 128
