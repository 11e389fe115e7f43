"""What the corpus operators move between tasks at size."""

import os

from pyspark.sql import functions as F

from spanlake.llm import op5_quality, op6_neardup, op10_licenses


def _shuffled(spark) -> int:
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_op5_labels_move_the_texts_of_the_sample_only(spark):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.sha2(F.concat(F.col("id").cast("string"), i.cast("string")), 256)))
    folder = spark.conf.get("spark.checkpoint.dir") + "/op5"
    spark.range(2000).select(F.col("id").alias("doc_id"), text.alias("text")).write.mode("overwrite").parquet(folder)
    docs, size = spark.read.parquet(folder), sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder))
    labels = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more labels than may be broadcast
    try:
        before = _shuffled(spark)
        assert op5_quality.train(docs, labels, sample=50) is not None
        assert _shuffled(spark) - before < size / 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_op10_takes_only_grams_of_template_words(spark):
    text = "plain words stand here " * 50 + "released under the mit license and more plain words " + "under by the " * 3
    words = text.split()
    lines = [t.split() for t, _, _ in op10_licenses.template_lines()]
    first, second = ({w for t in lines for w in t[j : len(t) - 1 + j]} for j in range(2))
    want = [i + 1 for i in range(len(words) - 1) if words[i] in first and words[i + 1] in second]
    rows = spark.createDataFrame([(text,), ("one",), ("",)], "text string").select(op10_licenses.words_of(F.col("text")).alias("w"))
    got = [r[0] for r in rows.select(op10_licenses._starts(F.col("w"), op10_licenses._vocabulary())).collect()]
    assert got == [want, [], []] and 0 < len(want) < 20


def test_op6_dropping_copies_does_not_move_the_texts_that_stay(spark):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.sha2(F.concat((F.col("id") % 990).cast("string"), i.cast("string")), 256)))
    folder = spark.conf.get("spark.checkpoint.dir") + "/op6"
    spark.range(1000).select(F.col("id").alias("doc_id"), text.alias("text")).write.mode("overwrite").parquet(folder)
    docs, size = spark.read.parquet(folder), sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more ids than may be broadcast unasked
    try:
        kept = op6_neardup.drop_near_duplicates(docs)
        before = _shuffled(spark)
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(990))
        assert _shuffled(spark) - before < size / 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
