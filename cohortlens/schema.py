"""Canonical table schemas (ten tables of the cohort warehouse)."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L, F = T.StringType(), T.DateType(), T.LongType(), T.DoubleType()


def _st(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "diagnosis_code": _st(("code", S), ("description", S)),
    "participant": _st(("participant_id", S), ("first_name", S), ("last_name", S),
                       ("date_of_birth", D), ("gender", S), ("race_ethnicity", S)),
    "enrollment": _st(("participant_id", S), ("start_date", D), ("end_date", D),
                      ("end_status", S), ("length_days", F)),
    "charge_offense": _st(("offense_id", L), ("offense_name", S), ("class", S)),
    "participant_charge": _st(("participant_id", S), ("offense_id", L), ("charge_date", D),
                              ("status_at_charge", S), ("outcome", S)),
    "participant_diagnosis": _st(("participant_id", S), ("diagnosis_code", S),
                                 ("diagnosis_description", S), ("assessment_date", D)),
    "risk_assessment": _st(("participant_id", S), ("assessment_date", D),
                           ("risk_score", F), ("risk_category", S)),
    "jail_data": _st(("participant_id", S), ("start_date", D), ("end_date", D),
                     ("days_incarcerated", F), ("cost", F)),
    "treatment_episode": _st(("participant_id", S), ("treatment_type", S), ("start_date", D),
                             ("end_date", D), ("service_type", S), ("provider", S), ("outcome", S)),
    # psychosocial carries extra source columns after the two canonical ones
    "psychosocial_assessment": _st(("participant_id", S), ("assessment_date", D)),
}

# Primary keys and required columns as declared by the warehouse DDL; enforced by the
# data-quality jobs rather than by storage.
PRIMARY_KEYS: dict[str, list[str]] = {
    "diagnosis_code": ["code"],
    "participant": ["participant_id"],
    "charge_offense": ["offense_id"],
}

REQUIRED: dict[str, list[str]] = {
    "diagnosis_code": ["code", "description"],
    "participant": ["participant_id", "first_name", "last_name", "date_of_birth", "gender"],
    "enrollment": ["participant_id", "start_date", "end_status"],
    "charge_offense": ["offense_id", "offense_name"],
    "participant_charge": ["participant_id", "offense_id", "charge_date"],
}

# child table -> (child key, parent table, parent key)
FOREIGN_KEYS: dict[str, list[tuple[str, str, str]]] = {
    "enrollment": [("participant_id", "participant", "participant_id")],
    "participant_charge": [("participant_id", "participant", "participant_id"),
                           ("offense_id", "charge_offense", "offense_id")],
    "participant_diagnosis": [("participant_id", "participant", "participant_id"),
                              ("diagnosis_code", "diagnosis_code", "code")],
    "risk_assessment": [("participant_id", "participant", "participant_id")],
    "jail_data": [("participant_id", "participant", "participant_id")],
    "treatment_episode": [("participant_id", "participant", "participant_id")],
    "psychosocial_assessment": [("participant_id", "participant", "participant_id")],
}

TABLES = list(SCHEMAS)
