"""License scans by diagonal voting, in DataFrame operations only.

Every rolling k-gram (k words) of a document whose words stand at its places in some template is hashed and joined with the
k-gram positions of the templates (others can't hit); each hit
votes for the diagonal document position - template position. Neighbouring diagonals of one template (words left out or
put in) are merged into spans, and a span is verified by the distinct template positions that voted for it: all of them
on one diagonal for a base phrase, a share of them for the longer license texts.

Templates are a fixed table of some hundred k-grams (TEXTS), so their side is broadcast; a template may have any number of
k-grams, whose votes are counted in blocks of 64 bits. Documents are read once; what is shuffled is the hits and one mark for
each document, whose row would else be lost in the inner join, both counted up before, so that rows that repeat an id and a
text are one however many they are.

Defined results: a null or empty text has no words: counts 0, no positions, empty labels, score 0. Rows that repeat the
same id and text each get the same result. Texts of any length are scanned whole. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake.llm.common import lower_ascii, table

#: Base phrases with their labels, then license texts that the method finds besides.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEXTS = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "lgpl": "licensed under the gnu lesser general public license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc-text": "this work is licensed under a creative commons attribution 4 0 international license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "as-is": "the software is provided as is without warranty of any kind express or implied",
}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2
#: Diagonals at most so far apart merge; the share of a text's k-grams that a span must cover, and the least of them.
NEAR, SHARE, LEAST = 3, 0.8, 3


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(lower_ascii(text), F.lit("")), F.lit(WORD), F.lit(0))


def _gram(words: Column, at: Column) -> Column:
    """Hash of the k-gram that begins at the word numbered at, from 1."""
    return F.xxhash64(*[F.element_at(words, (at + j).cast("int")) for j in range(K)])


def _starts(words: Column, vocabulary: list[set[str]] | None = None) -> Column:
    """Where k-grams begin, from 1; with a vocabulary only those whose j-th word is among its j-th words."""
    starts = F.when(F.size(words) >= K, F.sequence(F.lit(1), F.greatest(F.size(words) - K + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    if vocabulary is None:
        return starts
    return F.filter(starts, lambda i: reduce(Column.__and__, [F.element_at(words, (i + j).cast("int")).isin(sorted(v)) for j, v in enumerate(vocabulary)]))


def template_lines(texts: dict[str, str] | None = None) -> list[tuple[str, str, str]]:
    return [(text, label, "base") for text, label in BASE.items()] + [(text, label, "text") for label, text in (TEXTS if texts is None else texts).items()]


def _vocabulary(texts: dict[str, str] | None = None) -> list[set[str]]:
    """The j-th words of the templates' k-grams, for each j: a k-gram without them hits no template."""
    lines = [text.split(" ") for text, _, _ in template_lines(texts)]
    return [{w for words in lines for w in words[j : len(words) - K + 1 + j]} for j in range(K)]


def template_grams(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """gram, label, kind (base, text, mark), pos of the k-gram and total of them."""
    values = ", ".join(f"('{text}', '{label}', '{kind}')" for text, label, kind in template_lines(texts))
    templates = spark.sql(f"SELECT split(text, ' ') AS words, label, kind FROM VALUES {values} AS t(text, label, kind)")
    grams = templates.select(F.posexplode(F.transform(_starts(F.col("words")), lambda i: _gram(F.col("words"), i))).alias("pos", "gram"), "label", "kind", (F.size("words") - K + 1).alias("total"))
    return grams.unionByName(spark.sql("SELECT 0 AS pos, 0L AS gram, '' AS label, 'mark' AS kind, 0 AS total"))


def license_spans(docs: DataFrame, key: list[str], text: str = "text", texts: dict[str, str] | None = None) -> DataFrame:
    """One row a span and one of kind mark a document: key, n_words, label, kind, first, last, votes, total, copies.

    first and last are the words where the span's first and last k-gram begin; copies counts rows with the same key. texts:
    label -> license text in lower-case words, of any length, instead of TEXTS.
    """
    rows = docs.select(*key, words_of(F.col(text)).alias("__words"))
    words = F.col("__words")
    found = F.transform(_starts(words, _vocabulary(texts)), lambda i: F.struct((i - 1).alias("at"), _gram(words, i).alias("gram")))
    marked = F.concat(found, F.array(F.struct(F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("gram"))))
    grams = rows.select(*key, F.size(words).cast("long").alias("n_words"), F.explode(marked).alias("__gram")).select(*key, "n_words", F.col("__gram.at").alias("__at"), F.col("__gram.gram").alias("gram"))
    hits = grams.join(F.broadcast(template_grams(docs.sparkSession, texts)), "gram")
    hits = hits.withColumn("diagonal", F.when(F.col("kind") == "mark", F.lit(0)).otherwise(F.col("__at") - F.col("pos"))).withColumn("block", F.floor(F.col("pos") / 64))
    keys = [*key, "n_words", "label", "kind", "total"]
    votes = hits.groupBy(*keys, "diagonal", "block").agg(F.min("__at").alias("first"), F.max("__at").alias("last"), F.expr("bit_or(shiftleft(1L, pos % 64))").alias("covered"), F.count("*").alias("hits")).repartition(*key)
    w = Window.partitionBy(*keys).orderBy("diagonal", "block")
    apart = (F.col("kind") == "base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > NEAR, F.lit(True))
    votes = votes.withColumn("span", F.sum(apart.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    blocks = votes.groupBy(*keys, "span", "block").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.expr("bit_count(bit_or(covered))").alias("votes"), F.sum("hits").alias("copies"))
    spans = blocks.groupBy(*keys, "span").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("votes").alias("votes"), F.sum("copies").alias("copies"))
    enough = (F.col("votes") >= F.greatest(F.lit(LEAST), F.ceil(F.col("total") * SHARE))) & (F.col("last") - F.col("first") < 2 * F.col("total"))
    good = F.when(F.col("kind") == "base", F.col("votes") == F.col("total")).when(F.col("kind") == "text", enough).otherwise(F.lit(True))
    return spans.where(good)


def scan_documents(docs: DataFrame) -> DataFrame:
    """The digest columns of every document; score is the best span's share of its template's k-grams."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    key = ["doc_id", "text_hash"]
    spans = license_spans(keyed, key)
    base, mark = F.col("kind") == "base", F.col("kind") == "mark"
    names = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    found = spans.groupBy(*key, "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(~mark).alias("labels"),
        F.coalesce(F.max(F.when(~mark, F.col("votes") / F.col("total"))), F.lit(0.0)).alias("score"),
        F.max(F.when(mark, F.col("copies"))).alias("copies"),
    )
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))

