"""Input schemas and the fixed business values the reports need."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_LONG, _STR, _DATE = T.LongType(), T.StringType(), T.DateType()
_BOOL, _DBL, _TS = T.BooleanType(), T.DoubleType(), T.TimestampNTZType()

# Timestamps are zone-less on purpose: the reports compare wall-clock values, so the result
# must not move with the session time zone.
SCHEMAS: dict[str, T.StructType] = {
    "studies": _struct(id=_LONG, client_fk=_LONG, created_at=_TS, status=_STR, rules=_STR),
    "study_details": _struct(study_fk=_LONG, is_demo=_BOOL),
    "clients": _struct(
        id=_LONG, client_name=_STR, onboarded_at=_TS, saas_only=_BOOL,
        oms_partner=T.IntegerType(), unique_id=_STR, email=_STR,
    ),
    "client_details": _struct(client_fk=_LONG, client_source=_STR),
    "client_settings": _struct(client_fk=_LONG, enable_demo=_BOOL, billing_type=_STR),
    "client_contacts": _struct(
        id=_LONG, client_fk=_LONG, phone=_STR, email=_STR, designation=_STR, persona_type=_STR
    ),
    "client_tat_metrics": _struct(study_id=_LONG, modality=_STR, tat_min=_DBL),
    "phase_level_tat": _struct(study_id=_LONG, overall_tat=_DBL),
    "reworks": _struct(
        id=_LONG, study_fk=_LONG, created_at=_TS, status=_STR, by_user_type=_STR,
        complete_reason_fk=_LONG,
    ),
    "client_survey": _struct(
        id=_LONG, contact_fk=_LONG, client_fk=_LONG, client_active_type=_STR, churn_type=_STR,
        response=_STR, trigger=_BOOL, created_at=_TS, updated_at=_TS,
    ),
    "hourly_client_cases": _struct(
        client_fk=_LONG, client_name=_STR, onboarded_date=_DATE, case_receiving_date=_DATE,
        hour=T.IntegerType(), client_source=_STR, total_case=_LONG, Within_TAT=_LONG, tat_breach=_LONG,
    ),
    "daily_client_cases": _struct(
        client_fk=_LONG, client_name=_STR, onboarded_date=_DATE, case_receiving_date=_DATE,
        client_source=_STR, total_case=_LONG, Within_TAT=_LONG, tat_breach=_LONG,
    ),
}


class Tier(NamedTuple):
    """A churn tier: active days in [min_days, max_days] and silent for the last silent_days days."""

    min_days: int
    max_days: int
    silent_days: int
    churn_category: str
    client_active_type: str = "DAU"


# Churn tiers.
CHURN_TIERS = (
    Tier(30, 30, 1, "Critical DAU30 Cat-1 Churn"),
    Tier(28, 29, 3, "Critical DAU>28 Cat-2 Churn"),
    Tier(25, 27, 5, "Critical DAU>25 Cat-3 Churn"),
)

# Turn-around targets in minutes, and the labels shown in messages and mails.
DAILY_SLA = {"XRAY": 60, "CT": 120, "MRI": 180}
MODALITY_SLA = {"XRAY": 60, "CT": 120, "MRI": 180, "NM": 180}
MESSAGE_TAT_LABELS = {"XRAY": "60", "CT": "120", "MRI": "180", "NM": "2400"}
MAIL_TAT_LABELS = {"XRAY": "60 Mins", "CT": "120 Mins", "MRI": "180 Mins", "NM": "240 Mins"}

# First case date taken into the daily fact.
DAILY_SINCE = dt.date(2024, 4, 1)

# Account ids left out of the daily fact, the modality summary and the contact directory.
DAILY_EXCLUDED = (
    3680, 3681, 3682, 3683, 1040, 1433, 1474, 2350, 3741, 118, 519, 579,
    1912, 1139, 743, 1449, 2988, 2991, 2909, 2071, 1876, 730, 1738,
)
MODALITY_EXCLUDED = (
    1040, 1433, 1474, 2350, 3741, 118, 519, 579, 1912, 1139, 743, 1449,
    2988, 2991, 2909, 2071, 1876, 730,
)
DIRECTORY_EXCLUDED = (
    1040, 1433, 1474, 2350, 3741, 118, 519, 579, 1912, 1139, 743, 1449,
    2988, 2991, 2909, 2071, 1876, 730, 519,
)
