"""The summary and the report, and a saved model that scores as it did."""

from pyspark.sql import functions as F

from tallyweave.functions import contract
from tallyweave.operators import trees
from tallyweave.plans import report
from tallyweave.sources import files


def test_summary(spark):
    rows = [(0.9, 1)] * 8 + [(0.8, 0)] * 2 + [(0.4, 1)] * 2 + [(0.1, 0)] * 188
    said = report.summary(spark.createDataFrame(rows, "x double, y int"), 50.0)
    text = "\n".join(said)
    assert "AUC 0.9979" in text and "threshold 0.2500, as good from 0.1000 to 0.4000 (a wide range: 0.3000)" in text
    assert "10 hits, 2 false alarms, 0 misses, 188 left alone" in text and "precision 0.8333, recall 1.0000" in text
    assert "Under 50 alerts per 1,000" in text and "₹4,00,000" in text and "flag nobody" not in text
    assert "is flag none: ₹20,00,000" in text and "save ₹19,70,000 of it (98.5 %)" in text
    none = report.summary(spark.createDataFrame([(0.5, 0), (0.5, 0)], "x double, y int"), 20.0)
    assert any("n/a" in x for x in none) and any("no cut that flags anyone fits" in x for x in none)
    assert report.summary(spark.createDataFrame([], "x double, y int")) == ["No scores."]


def test_splice():
    doc = f"a\n{report.BEGIN}\nold\n{report.END}\nb"
    assert report.splice(doc, "new\n") == f"a\n{report.BEGIN}\nnew\n{report.END}\nb"
    for bad in ("nothing", doc + report.END, f"{report.END}{report.BEGIN}"):
        try:
            report.splice(bad, "x")
        except ValueError:
            continue
        raise AssertionError(bad)


def test_saved_model_scores_as_before(spark, tmp_path):
    names = list(contract.FEATURES)
    df = spark.range(300).select("id", *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 100.0).alias(f) for i, f in enumerate(names)])
    df = df.withColumn("y", (F.col(names[0]) + F.col(names[3]) > 11).cast("int"))
    model = trees.fit(df, names, rounds=5)
    files.save_artifacts(spark, str(tmp_path / "m"), model, names, {"optimal_threshold": 0.4})
    again = files.load_model(spark, str(tmp_path / "m"))
    assert {tuple(r) for r in again.scored(df).select("id", "margin").collect()} == {tuple(r) for r in model.scored(df).select("id", "margin").collect()}
