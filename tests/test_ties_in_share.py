"""The firm of the largest share, where shares differ by less than they are rounded to."""

from types import SimpleNamespace

from awardlens.plans import profiles


def test_top_firm_goes_by_value_and_not_by_the_rounded_share(spark):
    rows = [(firm, "o", 100_000.0 + (firm == 7) * 0.25) for firm in range(1, 9)]
    awards = spark.createDataFrame(rows, "firm long, office string, amount double").selectExpr("firm", "office", "CAST(amount AS DECIMAL(18,2)) AS amount")
    awards = awards.unionByName(awards.withColumn("firm", awards["firm"] + 1000))
    found = profiles.concentration_shares(SimpleNamespace(awards=awards))
    assert found.first().top_firm == 7
