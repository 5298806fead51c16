"""Fits of two members in closed form: thresholds that an advantage meets exactly are decided as the SQL decides them."""

import numpy as np
import oracle
import pandas as pd

from wayring.operators import templates as T
from wayring.plans import catalog


def test_advantages_on_a_threshold_are_told_as_by_sql(spark, tmp_path):
    rng, rows = np.random.default_rng(5), []
    for g in range(300):
        # differences, in cents of 105,000, at which the better template is better by 30 or 15 points to the digit
        at = int(rng.choice([3_762_500, 3_850_000, 1_225_000, 1_050_000])) * int(rng.choice([-1, 1]))
        apart = (at - int(rng.integers(60)) * (g % 5 - 2) * 87_500) % 10_500_000
        second = int(rng.integers(90_000, 10_490_000))
        rows += [(g, n, 1, 1, p / 100, "A") for n, p in ((1, (second + apart) % 10_500_000), (2, second))]
    pd.DataFrame(rows, columns=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"]).to_parquet(tmp_path / "lineitem.parquet")
    name = "rival_templates"
    assert oracle.differences(spark, oracle.connect(str(tmp_path)), name, catalog.QUERIES[name], catalog.ORACLE_SQL[name], str(tmp_path)) == []


def test_pairs_fit_as_by_the_search(spark):
    templates = [
        T.Template("same", "si", (T.Slot("a", "A", 0.1), T.Slot("b", "A", 0.6))),
        T.Template("turned", "so", (T.Slot("a", "A", 0.2, sign=-1), T.Slot("b", "A", 0.45))),
        T.Template("roles", "si", (T.Slot("a", "A", 0.0, role="lead"), T.Slot("b", "A", 0.25))),
        T.Template("mixed", "si", (T.Slot("a", "A", 0.0), T.Slot("b", "N", 0.25))),
        T.Template("three", "si", (T.Slot("a", "A", 0.0), T.Slot("b", "A", 0.25), T.Slot("c", "A", 0.5))),
    ]
    rng, rows = np.random.default_rng(7), []
    for g in range(120):
        for m in range(2 + (g % 10 == 0)):
            rows.append((g, m + 1, "N" if g % 3 == 0 and m == 1 else "A", float(rng.random()), "lead" if rng.random() < 0.4 else None))
    found = T.candidates(spark.createDataFrame(rows, "group_id long, member int, vehicle_type string, phase double, role string"), templates)
    told = lambda fits: {(r.group_id, r.template_id): [round(e, 9) for e in r.errors] for r in fits.collect()}
    expected = told(T.fitted(found.where("n = 2"), templates))
    assert told(T.pair_fits(found)) == expected
    assert {t for _, t in expected} == {"same", "turned", "roles", "mixed"}
