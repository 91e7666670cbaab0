"""Re-partitioning the inputs never changes a report; plans keep filters at the scan."""

from pyspark.sql import functions as F

from cohortlens.plans.registry import reports
from cohortlens.sources.bindings import load_tables
from tests.conftest import SF_SMALL

KEYS = ["r1_4", "r3_2", "r4_6", "r4_9", "r5_6", "r5_9"]


def test_repartitioning_inputs_does_not_change_reports(spark):
    base = load_tables(spark, SF_SMALL)
    shuffled = {}
    for name in ["participant", "enrollment", "participant_charge", "charge_offense", "participant_diagnosis"]:
        shuffled[name] = base[name].repartition(7, F.rand(3))
    rep = reports()
    for k in KEYS:
        a = sorted(map(tuple, rep[k](base).collect()), key=str)
        b = sorted(map(tuple, rep[k]({**{n: base[n] for n in
                                         ["risk_assessment", "jail_data", "treatment_episode",
                                          "diagnosis_code", "psychosocial_assessment"]},
                                      **shuffled}).collect()), key=str)
        assert a == b, k


def test_filters_and_pruning_reach_the_scan(spark):
    t = load_tables(spark, SF_SMALL)
    plan = t["participant_charge"].where(F.col("outcome") == "Convicted")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters" in plan and "l_returnflag" in plan
    assert "l_extendedprice" not in plan  # column pruning: unused columns are not read


def test_no_python_udf_in_report_plans(spark):
    from cohortlens.sources.store import stored_tables
    t = stored_tables(spark, SF_SMALL)
    for name, fn in reports().items():
        if name in ("csv_scan", "csv_positional", "union_tagged", "write_table", "export_csv",
                    "export_json", "publish_reports"):
            continue
        plan = fn(t)._jdf.queryExecution().optimizedPlan().toString()
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan, name
