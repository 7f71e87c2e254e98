import pytest

from tallyweave.operators.page_rules import apply_rules

SCHEMA = "page string, page_type string, field string, status string, value string, source string, flags array<string>, exclusive_group string, extra int"
V = "pregnancy.visit."
# page type, what is known, blank fields -> flags by field, reasons by blank field
CASES = {
    "edd": ("pregnancy", {"pregnancy.lmp_date": "2025-04-26", "pregnancy.edd": "2026-03-31"}, [], {"pregnancy.lmp_date": ["edd_inconsistent_with_lmp"], "pregnancy.edd": ["edd_inconsistent_with_lmp"]}, {}),
    "edd fits": ("pregnancy", {"pregnancy.lmp_date": "2025-04-26", "pregnancy.edd": "2026-01-31"}, [], {}, {}),
    "post term": ("pregnancy", {"pregnancy.edd": "2026-01-31", "pregnancy.term_exceeded_date": "2026-02-20"}, [], {"pregnancy.edd": ["post_term_inconsistent_with_edd"], "pregnancy.term_exceeded_date": ["post_term_inconsistent_with_edd"]}, {}),
    "visits": (
        "pregnancy",
        {"pregnancy.lmp_date": "2025-04-26", V + "t1v1.visit_date": "2025-07-01", V + "t1v3.visit_date": "2025-06-01", V + "t1v1.weight": "60.0", V + "t1v2.weight": "61.5", V + "m9.weight": "69.0", V + "t2v1.bp": "70/120", V + "t2v2.bp": "120/70", V + "t1v1.gest_age": "20.0", V + "t1v3.appointment": "2025-12-01"},
        [],
        {V + "t1v1.visit_date": ["gest_age_inconsistent_with_dates", "visits_out_of_order"], V + "t1v1.gest_age": ["gest_age_inconsistent_with_dates"], V + "t1v3.visit_date": ["appointment_far_from_visit", "visits_out_of_order"], V + "t1v3.appointment": ["appointment_far_from_visit"], V + "m9.weight": ["weight_jump_between_visits"], V + "t2v1.bp": ["bp_implausible"]},
        {},
    ),
    "outside": ("pregnancy", {"pregnancy.lmp_date": "2025-04-26", V + "m7.visit_date": "2025-04-01"}, [], {V + "m7.visit_date": ["visit_date_outside_pregnancy"]}, {}),
    "parity": ("history", {"history.gravidity": "2", "history.parity": "3", "history.living_children": "6"}, ["history.prev3.date", "history.prev4.mode", "history.prev5.weight"], {"history.gravidity": ["parity_exceeds_gravidity"], "history.parity": ["living_children_exceed_parity", "parity_exceeds_gravidity"], "history.living_children": ["living_children_exceed_parity"]}, {"history.prev4.mode": "beyond_parity", "history.prev5.weight": "beyond_parity"}),
    "abortions": ("history", {"history.gravidity": "3", "history.parity": "2", "history.anomaly.abortion.count": "2"}, [], {x: ["gravidity_lt_parity_plus_abortions"] for x in ("history.gravidity", "history.parity", "history.anomaly.abortion.count")}, {}),
    "mode": ("history", {"history.prev1.mode": "vaginal", "history.prev2.mode": "cesarean", "history.rubella_vaccinated": "false", "history.hepb_vaccinated": "true"}, ["history.prev1.cs_indication", "history.prev2.cs_indication", "history.rubella_date", "history.hepb_date"], {}, {"history.prev1.cs_indication": "not_a_cesarean", "history.rubella_date": "not_vaccinated"}),
    "vaginal": ("delivery", {"delivery.mode.vaginal": "true", "delivery.mode.cesarean_planned": "false", "delivery.mode.cesarean_emergency": "false"}, ["delivery.cesarean_indication"], {}, {"delivery.cesarean_indication": "not_a_cesarean"}),
    "no cesarean": ("delivery", {"delivery.mode.cesarean_emergency": "false", "delivery.cesarean_indication": "x"}, [], {"delivery.cesarean_indication": ["indication_without_cesarean"]}, {}),
    "half known": ("delivery", {"delivery.mode.cesarean_planned": "false", "delivery.cesarean_indication": "x"}, [], {}, {}),
    "stillborn": ("delivery", {"delivery.newborn_status.stillborn": "true", "delivery.newborn.gest_age": "38.0"}, ["delivery.newborn.weight", "delivery.newborn.head_circumference"], {}, {"delivery.newborn.weight": "stillborn", "delivery.newborn.head_circumference": "stillborn"}),
    "light": ("delivery", {"delivery.newborn.weight": "1400", "delivery.newborn.gest_age": "38.0"}, [], {"delivery.newborn.weight": ["birth_weight_inconsistent_with_term"], "delivery.newborn.gest_age": ["birth_weight_inconsistent_with_term"]}, {}),
    "mother": ("pp_late_mother", {"pp_late_mother.cesarean": "false", "pp_late_mother.medication_intake": "false", "pp_late_mother.bp": "300/80"}, ["pp_late_mother.scar_state", "pp_late_mother.medication_details"], {"pp_late_mother.bp": ["bp_implausible"]}, {"pp_late_mother.scar_state": "not_a_cesarean", "pp_late_mother.medication_details": "no_medication"}),
    "newborn": ("pp_early_newborn", {"pp_early_newborn.transfer": "false"}, ["pp_early_newborn.referral_facility"], {}, {"pp_early_newborn.referral_facility": "no_transfer"}),
    "cover": ("cover", {"history.gravidity": "1", "history.parity": "3"}, [], {}, {}),
}


def test_each_rule(spark):
    rows = []
    for name, (kind, known, blank, *_) in CASES.items():
        rows += [(name, kind, f, "KNOWN", v, "ocr", [], None, 1) for f, v in known.items()] + [(name, kind, f, "NOT_PROVIDED", None, "ink", None, None, 1) for f in blank]
    got = {(r["page"], r["field"]): r for r in apply_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for name, (_, known, blank, flags, reasons) in CASES.items():
        for f in known:
            assert sorted(got[name, f]["flags"]) == flags.get(f, []), (name, f)
            assert (got[name, f]["status"], got[name, f]["source"]) == ("KNOWN", "ocr")
        for f in blank:
            r, reason = got[name, f], reasons.get(f)
            assert (r["status"], r["source"], r["flags"]) == (("NOT_APPLICABLE", "rule", [f"not_applicable:{reason}"]) if reason else ("NOT_PROVIDED", "ink", [])), (name, f)


@pytest.mark.parametrize("kind", ["cover", None])
def test_groups_repeats_and_nulls(spark, kind):
    rows = [
        (None, kind, "a", "KNOWN", "true", "ocr", ["several_options_ticked"], "g", 1), (None, kind, "b", "NEEDS_REVIEW", "true", "ocr", None, "g", 1), (None, kind, "b", "NEEDS_REVIEW", "true", "ocr", None, "g", 1),
        (None, kind, "c", "KNOWN", "false", "ocr", [], "g", 1), (None, kind, "d", "KNOWN", "true", "ocr", [], "h", 1), (None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = apply_rules(df)
    got = {}
    for r in out.collect():
        got.setdefault(r["field"], []).append(r["flags"])
    several = ["several_options_ticked"]
    assert out.columns == df.columns
    assert got == {"a": [several], "b": [several, several], "c": [[]], "d": [[]], None: [[]]}
    assert apply_rules(df.limit(0)).count() == 0
