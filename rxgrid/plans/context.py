"""Wire the operators to the adapter tables: one place that knows which table
feeds which operator, shared by ``__spark_entry__``, the bench and the tests."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxgrid.operators import decision, geo, metrics
from rxgrid.plans.pairs import PairInputs
from rxgrid.session import shared_table
from rxgrid.sources.adapter import Adapter

#: What the views over the prescriptions read of them.
PRESCRIPTION_COLUMNS = [
    "bene_synth_id", "ndc", "drug_name", "fills_per_year", "days_supply_mode", "tier_level", "is_insulin",
    "estimated_annual_drug_cost",
]


class Context:
    """Lazily built gold / ml inputs for one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, tables: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.a = Adapter(spark, sf_dir)
        self.tables = dict(tables or {})

    def t(self, name: str) -> DataFrame:
        """A source table: a stored bronze table when one was given, else the adapter view."""
        if name in self.tables:
            return self.tables[name]
        return self.a.table(name)

    def by_beneficiary(self) -> Callable[[str], DataFrame]:
        """``t`` for views over the prescriptions as one list per beneficiary, which all of a plan's views take from the same exchange."""
        if "_by_beneficiary" not in self.__dict__:
            # a list is not pruned to the columns of one view, so the exchange below it is the same for all of them
            row = F.struct(*PRESCRIPTION_COLUMNS[1:])
            lists = self.t("prescriptions").groupBy("bene_synth_id").agg(F.collect_list(row).alias("rows"))
            self.__dict__["_by_beneficiary"] = self.a.over(prescriptions=lists.select("bene_synth_id", F.inline("rows")))
        views = self.__dict__["_by_beneficiary"]
        return lambda name: self.tables[name] if name in self.tables else views.table(name)

    @cached_property
    def formulary_metrics(self) -> DataFrame:
        return metrics.formulary_metrics(self.t("plan_info"), self.t("formulary"), self.t("insulin_ref"))

    @cached_property
    def network_metrics(self) -> DataFrame:
        return metrics.network_metrics(self.t("pharmacy_network"))

    @cached_property
    def zip_county(self) -> DataFrame:
        return geo.resolve_zip_county(self.t("zipcode"), self.t("geographic"))

    @cached_property
    def county_density(self) -> DataFrame:
        return geo.county_density(self.zip_county)

    @cached_property
    def distance_features(self) -> DataFrame:
        return geo.plan_distance_features(self.t("plan_info"), self.county_density, self.network_metrics)

    @cached_property
    def gate(self) -> decision.Gate:
        return decision.Gate(self.t("requests"), self.t("plan_info"), self.formulary_metrics, self.network_metrics,
                             self.t("request_medications"), self.t("formulary"), self.t("excluded_drugs"))

    @cached_property
    def training_pairs(self) -> DataFrame:
        from rxgrid.plans import pairs

        # The cost sums are reused by many registered queries in one session (kept in memory, on disk when large);
        # the plan attributes are attached where they are read.
        inp = self.pair_inputs()
        costs = pairs.pair_costs(inp, plans=self.plan_side).persist(StorageLevel.MEMORY_AND_DISK)
        return pairs.training_pairs(inp, costs=costs, plans=self.plan_side)

    @property
    def pairs_once(self) -> DataFrame:
        """The training pairs for a query that reads them once: nothing is kept, and what it does not read is not carried."""
        if "training_pairs" in self.__dict__:
            return self.training_pairs
        from rxgrid.plans import pairs

        return pairs.training_pairs(self.pair_inputs(), plans=self.plan_side)

    @cached_property
    def plan_side(self) -> DataFrame:
        """The plans by county with their metrics, made once for the costs of the pairs and for the pairs."""
        from rxgrid.plans import pairs

        return shared_table(pairs.plan_side(self.pair_inputs()), "plans")

    def pair_inputs(self, with_metrics: bool = True) -> PairInputs:
        return PairInputs(
            beneficiary=self.t("beneficiary"),
            plan_info=self.t("plan_info"),
            prescriptions=self.t("prescriptions"),
            formulary=self.t("formulary"),
            excluded_drugs=self.t("excluded_drugs"),
            pricing=self.t("pricing"),
            beneficiary_cost=self.t("beneficiary_cost"),
            insulin_cost=self.t("insulin_cost"),
            formulary_metrics=self.formulary_metrics if with_metrics else None,
            network_metrics=self.network_metrics if with_metrics else None,
            distance_features=self.distance_features if with_metrics else None,
        )
