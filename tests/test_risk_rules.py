"""Rule tables of the form scoring."""

import pytest

from solea.operators import risk_rules as R

FULL = {"mf_L_hallux": "y", "mf_L_mth1": "y", "mf_L_mth5": "y", "abi_L": "normal", "ulcer_L": "no", "amp_L": "no", "ckd": "no"}
LOSS = {"mf_L_hallux": "n", "mf_L_mth1": "n", "mf_L_mth5": "n"}


def score(spark, rows):
    df = spark.createDataFrame([(i, "L", {k: v for k, v in r.items()}) for i, r in enumerate(rows)], "i int, side string, fields map<string,string>")
    return [r for r in R.score_side(df).orderBy("i").collect()]


CASES = [
    (FULL, dict(lops=False, pad=False, category=0, label="Negative", missing=[])),
    (FULL | {"mf_L_hallux": "n"}, dict(lops=False, category=0)),
    (FULL | {"mf_L_hallux": "n", "mf_L_mth1": "n"}, dict(lops=True, category=1, label="Positive")),
    ({"mf_L_hallux": "n", "mf_L_mth1": "n"}, dict(lops=True, pad=None, category=None, label=None)),  # two misses decide early
    ({"mf_L_hallux": "y", "mf_L_mth1": "y"}, dict(lops=False)),
    ({"mf_L_hallux": "y", "mf_L_mth1": "n"}, dict(lops=None)),
    ({"mf_L_hallux": "y", "mf_L_mth1": "n", "mf_L_mth5": ""}, dict(lops=None)),  # empty text is no answer
    (FULL | LOSS | {"abi_L": "pad"}, dict(lops=True, pad=True, category=2)),
    (FULL | LOSS | {"def_L_claw": "true"}, dict(deformity=True, category=2, deformities=[R.DEFORMITY_LABELS["claw"]])),
    (FULL | {"def_L_claw": "true"}, dict(deformity=True, category=0)),
    (FULL | LOSS | {"ulcer_L": "yes"}, dict(history=True, category=3, history_only=False)),
    (FULL | {"ckd": "yes"}, dict(history=True, category=0, history_only=True)),
    (FULL | {"abi_L": "calcified"}, dict(pad=None, need_tbi=True, missing=["TBI"])),
    (FULL | {"abi_L": "calcified", "tbi_L": "pad"}, dict(pad=True, category=1)),
    (FULL | {"abi_L": "calcified", "tbi_L": "normal"}, dict(pad=False, category=0)),
    (FULL | {"abi_L": "odd"}, dict(pad=None, category=None, missing=[])),
    ({}, dict(lops=None, pad=None, missing=[R.MISSING_MONOFILAMENT, "ABI", R.MISSING_ULCER, R.MISSING_AMPUTATION])),
]


def test_rule_table(spark):
    got = score(spark, [c for c, _ in CASES])
    for (fields, want), row in zip(CASES, got):
        assert {k: row[k] for k in want} == want, fields


def test_whole_form_exports(spark):
    other = {k.replace("_L_", "_R_").replace("abi_L", "abi_R"): v for k, v in (LOSS | {"abi_L": "pad"}).items()}
    fields = FULL | other | {"ulcer_R": "no", "amp_R": "no", "note": 'a "b"'}
    df = spark.createDataFrame([("P0003", "2024", "nurse_a", "nurse_a", fields)], "pid string, savedAt string, nurse string, nurse2 string, fields map<string,string>")
    scored = R.score_forms(df).cache()
    row = R.raw_form_export(scored).first()
    assert (row.iwgdf_category_L, row.iwgdf_category_R, row.iwgdf_label_patient) == ("0", "2", "Positive")
    assert [r.category for r in R.training_export(scored).orderBy("side").collect()] == ["0", "2"]
    assert R.form_missing_items(scored).first().need == [R.NEED_TWO_EXAMINERS]
    assert '"a ""b"""' in R.csv_lines(R.raw_form_export(scored), R.RAW_COLUMNS).first().value


@pytest.mark.parametrize("abi,band", [(0.89, "pad"), (0.9, "normal"), (1.3, "normal"), (1.31, "calcified")])
def test_abi_band(spark, abi, band):
    assert spark.range(1).select(R.abi_band(R.F.lit(abi))).first()[0] == band
