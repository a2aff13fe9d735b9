"""Drug searches shuffle hits only, and count each once."""

from pyspark.sql import functions as F

from rxgrid.operators import drugs


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if " Exchange " in line]


def test_search_indexes_are_not_shuffled(spark):
    names = spark.createDataFrame([("Aspirin Forte", "00011122233", "pain"), ("aspirin", "00011122234", "ASPIRIN x"), ("Zinc", "00090122233", "")],
                                  "drug_name string, ndc string, drug_synonym string")
    asked = spark.createDataFrame([(" aspirin ",), ("11122",), ("nc",), ("x",)], "query_text string")
    found = drugs.name_dictionary_search(asked, names.unionByName(names))
    assert not any("_gram" in x for x in _exchanges(found))
    got = [tuple(r) for r in found.select("query_text", "drug_name", "score", "rank").orderBy("query_text", "rank").collect()]
    assert got == [(" aspirin ", "aspirin", 1.0, 1), (" aspirin ", "Aspirin Forte", 0.5, 2), ("nc", "Zinc", 0.5, 1)]
    rx = names.select("*", *[F.lit(v).alias(c) for c, v in (("tier_level", 2), ("days_supply_mode", 30), ("fills_per_year", 4), ("is_insulin", 0), ("estimated_annual_drug_cost", 5.0))])
    hits = drugs.search_catalog(asked, drugs.drug_catalog(rx))
    assert not any("_gram" in x for x in _exchanges(hits))
    assert sorted((r.query_text, r.drug_name) for r in hits.collect()) == [
        (" aspirin ", "Aspirin Forte"), (" aspirin ", "aspirin"), ("11122", "Aspirin Forte"), ("11122", "aspirin"), ("nc", "Zinc")]


def test_search_counts_a_row_found_by_text_and_by_ndc_once(spark):
    rx = spark.createDataFrame([("drug 1234", "s", "00000001234", 1, 30, 2.0, 0, 8.0)] * 2 + [(None, None, "00000001234", 1, 60, 4.0, 0, 9.0)],
                               "drug_name string, drug_synonym string, ndc string, tier_level int, days_supply_mode int, fills_per_year double, is_insulin int, estimated_annual_drug_cost double")
    got = drugs.search_catalog(spark.createDataFrame([("1234",)], "query_text string"), drugs.drug_catalog(rx)).collect()
    assert [(r.drug_name, r.fills_per_year, r.annual_cost_est) for r in got] == [("NDC 00000001234", 4.0, 9.0), ("drug 1234", 2.0, 8.0)]
