"""Source schema contracts (A2): the declared layouts of the plan-data files."""

from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType


def _s(*cols):
    return StructType([StructField(n, t, True) for n, t in cols])


S, D, I, B = StringType(), DoubleType(), IntegerType(), BooleanType()

PLAN_INFO = _s(("contract_id", S), ("plan_id", S), ("segment_id", S), ("contract_name", S), ("plan_name", S),
               ("formulary_id", S), ("premium", D), ("deductible", D), ("ma_region_code", S), ("pdp_region_code", S),
               ("state", S), ("county_code", S), ("snp", I), ("plan_suppressed_yn", S))
BASIC_FORMULARY = _s(("formulary_id", S), ("formulary_version", S), ("contract_year", S), ("rxcui", S), ("ndc", S),
                     ("tier_level_value", D), ("quantity_limit_yn", S), ("quantity_limit_amount", S),
                     ("quantity_limit_days", S), ("prior_authorization_yn", S), ("step_therapy_yn", S))
EXCLUDED_DRUGS = _s(("contract_id", S), ("plan_id", S), ("rxcui", S), ("tier", D), ("quantity_limit_yn", S),
                    ("quantity_limit_amount", S), ("quantity_limit_days", S), ("prior_auth_yn", S),
                    ("step_therapy_yn", S), ("capped_benefit_yn", S))
INDICATION_COVERAGE = _s(("contract_id", S), ("plan_id", S), ("rxcui", S), ("disease", S))
_chan = []
for _c in ("pref", "nonpref", "mail_pref", "mail_nonpref"):
    _chan += [(f"cost_type_{_c}", I), (f"cost_amt_{_c}", D), (f"cost_min_amt_{_c}", S), (f"cost_max_amt_{_c}", D)]
BENEFICIARY_COST = _s(("contract_id", S), ("plan_id", S), ("segment_id", S), ("coverage_level", I), ("tier", D),
                      ("days_supply", I), *_chan, ("tier_specialty_yn", S), ("ded_applies_yn", S))
INSULIN_COST = _s(("contract_id", S), ("plan_id", S), ("segment_id", S), ("tier", S), ("days_supply", I),
                  ("copay_amt_pref_insln", D), ("copay_amt_nonpref_insln", D), ("copay_amt_mail_pref_insln", D),
                  ("copay_amt_mail_nonpref_insln", D))
PRICING = _s(("contract_id", S), ("plan_id", S), ("segment_id", S), ("ndc", S), ("days_supply", I), ("unit_cost", D))
PHARMACY_NETWORK = _s(("contract_id", S), ("plan_id", S), ("segment_id", S), ("pharmacy_number", S),
                      ("pharmacy_zipcode", S), ("preferred_status_retail", S), ("preferred_status_mail", S),
                      ("pharmacy_retail", S), ("pharmacy_mail", S), ("in_area_flag", I), ("floor_price", D),
                      ("brand_dispensing_fee_30", D), ("brand_dispensing_fee_60", D), ("brand_dispensing_fee_90", D),
                      ("generic_dispensing_fee_30", D), ("generic_dispensing_fee_60", D), ("generic_dispensing_fee_90", D))
GEOGRAPHIC = _s(("county_code", S), ("statename", S), ("county", S), ("ma_region_code", S), ("ma_region", S),
                ("pdp_region_code", S), ("pdp_region", S))
ZIPCODE = _s(("zip_code", S), ("city", S), ("state", S), ("county", S), ("lat", D), ("lng", D), ("population", D),
             ("density", D))
INSULIN_REF = _s(("ndc", S), ("rxcui", S), ("source", S), ("source_year", I), ("is_insulin", I))
