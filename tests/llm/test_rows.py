"""Rows that share an id or have none: samples stay bounded, mixes keep their targets, repeats cost nothing."""

from fractions import Fraction

from pyspark.sql import functions as F

from vecforge.llm import mixing, quality_classifier, substring_dedup, toxicity

from . import brute


def test_labelled_sample_has_one_row_an_id(spark):
    docs = spark.range(6000).select(F.when(F.col("id") < 5000, F.lit(3)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 700).alias("text"), F.col("id").alias("n_chars"))
    docs = docs.unionByName(spark.createDataFrame([(7000, None, 1), (7000, "a", 2), (None, "b", 3)], "doc_id long, text string, n_chars long")).repartition(6)
    labels = docs.select("doc_id").distinct().withColumn("toxic", F.lit(1)).withColumn("quality", F.lit(0))
    for rows in (100, 10_000):
        got = toxicity._labelled(docs, labels, "toxic", "doc_id", "text", rows, ("n_chars",)).collect()
        assert len(got) <= rows and len({r.doc_id for r in got}) == len(got) > 90
        again = toxicity._labelled(docs.repartition(3), labels, "toxic", "doc_id", "text", rows, ("n_chars",)).collect()
        assert sorted(got) == sorted(again)
    told = {r.doc_id: r for r in got}
    assert 7000 not in told or told[7000].text is None
    least = docs.where("doc_id = 3").select(F.min(F.struct(F.xxhash64("text"), "text"))).first()[0]["text"]
    assert 3 not in told or told[3].text == least


def test_classifiers_take_one_row_an_id(spark):
    rows = [(k % 40, f"w{k % 40} good words here" if k % 2 else f"bad x{k % 40} <br>", k) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)], "doc_id long, toxic int, quality int")
    model = quality_classifier.fit(docs, labels)
    once = docs.dropDuplicates(["doc_id"])
    same = quality_classifier.fit(once, labels)
    assert model.bias == same.bias
    assert toxicity.fit(docs, labels).tokens.tolist() == toxicity.fit(docs, labels).tokens.tolist()


def test_a_mix_keeps_its_targets_without_ids(spark, tmp_path):
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 4 < 2, "a").otherwise("b").alias("source"), F.col("id").alias("row"), F.lit("t").alias("text"), F.lit(1).alias("Slot"))
    weights = {"a": 3, "b": 1}
    laid = mixing.mix(rows, weights, block_rows=10)
    assert laid.columns == rows.columns
    laid.repartition(5).write.parquet(f"{tmp_path}/other")  # a plan of its own, as callers may add to it
    laid.write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out").withColumn("file", F.input_file_name()).collect()
    assert sorted(r.row for r in got) == sorted(r.row for r in spark.read.parquet(f"{tmp_path}/other").collect()) == list(range(4000))
    files = sorted({r.file for r in got})
    order = [r for f in files for r in got if r.file == f]
    share = Fraction(3, 4)
    for n in range(40, 2600, 40):  # both sources have rows left
        a = sum(r.source == "a" for r in order[:n])
        assert abs(a - n * share) <= 10 * 2
    for n in range(0, 4000, 400):  # rows without an id lie everywhere
        assert 0.2 < sum(r.doc_id is None for r in order[n : n + 400]) / 400 < 0.8


def test_a_mix_places_each_source_of_one_id(spark):
    rows = spark.createDataFrame([(k // 2, "ab"[k % 2], k) for k in range(400)], "doc_id long, source string, row long")
    order = [r.source for r in mixing.mix(rows, {"a": 1, "b": 1}, block_rows=1).collect()]
    for n in range(10, 400, 10):
        assert abs(order[:n].count("a") - n / 2) <= 2


def test_repeats_of_one_row_in_substrings(spark):
    rows = [(5, " ".join(f"w{i}" for i in range(20)))] * 10_000 + [(2, " ".join(f"w{i}" for i in range(3, 18)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring_dedup.deduplicate(docs).groupBy("doc_id", "n_words", "n_removed", "kept").count().collect()
    want = dict(brute.removed_rows(rows[-2:]))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want and {r["count"] for r in got} == {10_000, 1}
