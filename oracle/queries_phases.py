"""Oracle SQL for the per-fill cost logic queries."""

from oracle import pairs  # noqa: F401
from oracle.queries_core import _m  # noqa: F401  (registers o_top5)
from oracle.registry import cte, register

_fee = ("CASE WHEN is_brand THEN (CASE WHEN days >= 75 THEN brand_dispensing_fee_90 WHEN days >= 45 THEN brand_dispensing_fee_60 "
        "ELSE brand_dispensing_fee_30 END) ELSE (CASE WHEN days >= 75 THEN generic_dispensing_fee_90 "
        "WHEN days >= 45 THEN generic_dispensing_fee_60 ELSE generic_dispensing_fee_30 END) END")


def chan(price: str, t: str, a: str) -> str:
    rate = f"(CASE WHEN {a} > 1.0 THEN {a} / 100.0 ELSE {a} END)"
    return f"least(CASE WHEN {t} = 1 THEN {a} WHEN {t} = 2 THEN {price} * {rate} END, {price})"


cte("o_fills", ("o_top5", "plan_info", "pde_events", "pricing", "pharmacy_network", "o_formulary_map",
                "beneficiary_cost", "o_insulin_rules", "insulin_ref"), f"""
SELECT *, greatest(coalesce(unit_cost, 0.0) * qty + coalesce(fee, 0.0), coalesce(CAST(floor_price AS double), 0.0)) AS price,
  coalesce(t_pref, 0) AS cost_type, coalesce(a_pref, 0.0) AS cost_amt,
  CASE WHEN is_insulin = 1 THEN 0 ELSE coalesce(ded, 0) END AS ded_applies
FROM (
  SELECT c.*, t.plan_key, t.plan_deductible, pr.unit_cost, r.floor_price, {_fee} AS fee,
    coalesce(fm.formulary_tier, 1) AS tier, bc.t_pref, bc.a_pref, bc.t_nonpref, bc.a_nonpref, bc.t_mail_pref,
    bc.a_mail_pref, bc.t_mail_nonpref, bc.a_mail_nonpref, bc.ded, ir.pref_insulin_copay AS insulin_copay,
    coalesce(ins.is_insulin, 0) AS is_insulin
  FROM (SELECT bene_id AS bene_synth_id, prod_srvc_id AS ndc, srvc_dt, claim_id, days_suply_num AS days,
          qty_dspnsd_num AS qty, brnd_gnrc_cd = 'B' AS is_brand,
          CASE WHEN days_suply_num >= 75 THEN 2 WHEN days_suply_num >= 45 THEN 4 ELSE 1 END AS dsc FROM pde_events) c
  JOIN (SELECT bene_synth_id, plan_key, plan_deductible FROM o_top5 WHERE recommendation_rank = 1) t
    ON t.bene_synth_id = c.bene_synth_id
  JOIN (SELECT DISTINCT plan_key, formulary_id FROM plan_info) p ON p.plan_key = t.plan_key
  LEFT JOIN (SELECT plan_key, ndc, days_supply_code, avg(unit_cost) AS unit_cost FROM pricing GROUP BY 1, 2, 3) pr
    ON pr.plan_key = t.plan_key AND pr.ndc = c.ndc AND pr.days_supply_code = c.dsc
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_key ORDER BY pharmacy_number) AS rn
             FROM pharmacy_network WHERE upper(preferred_status_retail) = 'Y') WHERE rn = 1) r ON r.plan_key = t.plan_key
  LEFT JOIN o_formulary_map fm ON fm.formulary_id = p.formulary_id AND fm.ndc = c.ndc
  LEFT JOIN (SELECT plan_key, CAST(tier AS integer) AS tier, days_supply AS dsc,
               CAST(cost_type_pref AS integer) AS t_pref, cost_amt_pref AS a_pref,
               CAST(cost_type_nonpref AS integer) AS t_nonpref, cost_amt_nonpref AS a_nonpref,
               CAST(cost_type_mail_pref AS integer) AS t_mail_pref, cost_amt_mail_pref AS a_mail_pref,
               CAST(cost_type_mail_nonpref AS integer) AS t_mail_nonpref, cost_amt_mail_nonpref AS a_mail_nonpref,
               CASE WHEN ded_applies_yn = 'Y' THEN 1 ELSE 0 END AS ded
             FROM beneficiary_cost WHERE coverage_level = 1) bc
    ON bc.plan_key = t.plan_key AND bc.tier = coalesce(fm.formulary_tier, 1) AND bc.dsc = c.dsc
  LEFT JOIN o_insulin_rules ir ON ir.plan_key = t.plan_key AND ir.days_supply_code = c.dsc AND ir.tier IS NULL
  LEFT JOIN (SELECT DISTINCT ndc, 1 AS is_insulin FROM insulin_ref WHERE ndc IS NOT NULL) ins ON ins.ndc = c.ndc
)
""")

register("N1_negotiated_price", ["o_fills"], f"""
SELECT claim_id, plan_key, unit_cost, fee, price, {chan('price', 'cost_type', 'cost_amt')} AS pref_channel_cost,
  least(insulin_copay, price) AS insulin_member_cost
FROM o_fills
""")

cte("o_prog1", ("o_fills",), """
SELECT *, least(s, coalesce(CAST(plan_deductible AS double), 0.0)) - least(s - elig, coalesce(CAST(plan_deductible AS double), 0.0))
  AS ded_used
FROM (SELECT *, CASE WHEN ded_applies = 1 THEN price ELSE 0.0 END AS elig,
        sum(CASE WHEN ded_applies = 1 THEN price ELSE 0.0 END) OVER (PARTITION BY bene_synth_id, plan_key
          ORDER BY srvc_dt, claim_id, ndc, price ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
      FROM o_fills)
""")
cte("o_prog2", ("o_prog1",), f"""
SELECT *, CASE WHEN price - ded_used > 0 THEN
    CASE WHEN is_insulin = 1 THEN least(coalesce(insulin_copay, price - ded_used), price - ded_used)
         ELSE coalesce({chan('(price - ded_used)', 'cost_type', 'cost_amt')}, price - ded_used) END
  ELSE 0.0 END AS initial_share
FROM o_prog1
""")
register("N4_annual_progression", ["o_prog2"], """
SELECT claim_id, bene_synth_id, plan_key, price, ded_used, initial_share,
  greatest(least(c, 2000.0) - least(c - part, 2000.0), 0.0) AS member_paid, least(c, 2000.0) AS oop_to_date
FROM (SELECT *, ded_used + initial_share AS part,
        sum(ded_used + initial_share) OVER (PARTITION BY bene_synth_id, plan_key ORDER BY srvc_dt, claim_id, ndc, price
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM o_prog2)
""")
_opts = " UNION ALL ".join(
    f"SELECT claim_id, '{c}' AS channel, {chan('price', f't_{c}', f'a_{c}')} AS channel_cost FROM o_fills"
    for c in ("pref", "nonpref", "mail_pref", "mail_nonpref"))
register("N5_best_channel", ["o_fills"], f"""
SELECT claim_id, arg_min(channel, channel_cost * 1e6 + CASE channel WHEN 'mail_nonpref' THEN 0 WHEN 'mail_pref' THEN 1
    WHEN 'nonpref' THEN 2 ELSE 3 END) AS best_channel, min(channel_cost) AS best_channel_cost
FROM ({_opts}) WHERE channel_cost IS NOT NULL GROUP BY claim_id
""")
register("N6_lis_capped", ["o_fills"], f"""
SELECT claim_id, least(coalesce({chan('price', 'cost_type', 'cost_amt')}, price), CASE WHEN is_brand THEN 12.15 ELSE 4.90 END)
  AS lis_member_cost
FROM o_fills
""")
register("N7_rule_rank", ["o_training_pairs"], """
SELECT bene_synth_id, plan_key, row_number() OVER (PARTITION BY bene_synth_id ORDER BY
  CASE WHEN uncovered_drug_count = 0 THEN 0 ELSE 1 END, total_annual_cost ASC NULLS LAST, uncovered_drug_count,
  network_adequacy_flag, plan_key) AS rule_rank
FROM o_training_pairs
""")
register("N8_claim_defaults", ["pde_events"], """
SELECT q.prod_srvc_id, q.avg_qty_per_fill, m.days AS typical_days_supply, q.claims, f.avg_fills_per_bene_year
FROM (SELECT prod_srvc_id, avg(qty_dspnsd_num) AS avg_qty_per_fill, count(*) AS claims FROM pde_events GROUP BY 1) q
JOIN (SELECT prod_srvc_id, days FROM (SELECT prod_srvc_id, days_suply_num AS days, row_number() OVER (
        PARTITION BY prod_srvc_id ORDER BY count(*) DESC, days_suply_num) AS rn FROM pde_events GROUP BY 1, 2) WHERE rn = 1) m
  ON m.prod_srvc_id = q.prod_srvc_id
JOIN (SELECT prod_srvc_id, avg(n) AS avg_fills_per_bene_year FROM (SELECT prod_srvc_id, bene_id, year(srvc_dt), count(*) AS n
        FROM pde_events GROUP BY 1, 2, 3) GROUP BY 1) f ON f.prod_srvc_id = q.prod_srvc_id
""")
