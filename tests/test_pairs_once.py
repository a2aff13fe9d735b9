"""Queries that read the pairs once keep nothing of them."""

import numpy as np

from rxgrid.operators import lambdamart as LM
from rxgrid.plans import queries_core, queries_ml  # noqa: F401
from rxgrid.plans.registry import QUERIES, context


def _tables(spark, at):
    spark.createDataFrame([(n, f"N{n}", n % 2) for n in range(3)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{at}/nation.parquet")
    spark.createDataFrame([(r, f"R{r}") for r in range(2)], "r_regionkey long, r_name string").write.parquet(f"{at}/region.parquet")
    spark.createDataFrame([(c, c % 3) for c in (1, 2, 3, 4, 4)], "c_custkey long, c_nationkey long").write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame([(s, f"S{s}", s % 3) for s in range(1, 25)], "s_suppkey long, s_name string, s_nationkey long").write.parquet(f"{at}/supplier.parquet")
    spark.createDataFrame([(p, f"a{p} b{p}", f"t{p}", f"b{p}", p) for p in range(1, 6)],
                          "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{at}/part.parquet")
    spark.createDataFrame([(o, o % 4 + 1) for o in range(1, 13)], "o_orderkey long, o_custkey long").write.parquet(f"{at}/orders.parquet")
    lines = [(o, o % 5 + 1, (o * 7 + k) % 24 + 1, float(o * 3 + k), 100.0 * (o + k)) for o in range(1, 13) for k in range(3)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{at}/lineitem.parquet")


def test_gradients_and_ranks_store_no_pairs(spark, tmp_path, monkeypatch):
    _tables(spark, tmp_path)
    written = []
    stored = queries_ml.shared_table
    monkeypatch.setattr(queries_ml, "shared_table", lambda df, name="step": written.append(name) or stored(df, name))
    got = {(r.bene_synth_id, r.plan_key): (r.gradient, r.curvature) for r in QUERIES["I11_lambda_gradients"](spark, str(tmp_path)).collect()}
    top = QUERIES["H1_top5_plans"](spark, str(tmp_path)).count()
    ctx = context(spark, str(tmp_path))
    assert "labeled" not in written and "training_pairs" not in ctx.__dict__
    # the same as from the labels that are kept
    labels = QUERIES["I9_relevance_labels"](spark, str(tmp_path)).toPandas()
    want = {}
    for bene, rows in labels.groupby("bene_synth_id"):
        rows = rows.sort_values("plan_key", kind="stable")
        g, h = LM.gradients(np.zeros(len(rows)), rows.relevance_label.to_numpy(float))
        want |= {(bene, p): v for p, v in zip(rows.plan_key, zip(g, h))}
    assert got.keys() == want.keys() and len(got) > 20 and np.allclose([got[k] for k in got], [want[k] for k in got])
    sizes = labels.groupby("bene_synth_id").size()
    assert top >= sizes.clip(upper=5).sum() and top <= 5 * len(sizes)  # (labels leave out pairs without a premium)
