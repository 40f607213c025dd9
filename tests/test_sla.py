from __future__ import annotations

import datetime as dt
import random

import pytest

from casepulse.operators import sla
from casepulse.schemas import MODALITY_SLA
from tests.conftest import rows_of

AS_OF = dt.date(2024, 6, 30)


def rules(name):
    return f'[{{"list":["{name}"]}}]'


def ts(day):
    return dt.datetime.combine(day, dt.time(12))


@pytest.fixture(scope="module")
def make(table):
    def run(studies, reworks=(), tat=(), clients=((1, "one"),), month=False, **options):
        options.setdefault("exclude", None)
        frames = table("studies", studies), table("phase_level_tat", tat), table("clients", clients)
        if month:
            return sla.modality_sla_month(frames[0], frames[1], frames[2], as_of=AS_OF, **options)
        return sla.modality_sla_summary(
            frames[0], table("reworks", reworks), frames[1], frames[2], as_of=AS_OF, **options
        )

    return run


def rework(number, study, user="CLIENT", status="COMPLETED", reason=None):
    return (number, study, ts(AS_OF), status, user, reason)


def brute(studies, reworks, tat, recent, missing=0.0):
    """Joined rows one by one, as a plain left join makes them."""
    want = {}
    for study, client, created, status, rule in studies:
        blocks = (["total"] if status == "COMPLETED" else []) + (["recent"] if recent(created.date()) else [])
        if not blocks:
            continue
        name = rule.split('"')[3]
        hits = [r[0] for r in reworks if r[1] == study and r[3] == "COMPLETED"
                and r[4] in ("CLIENT", "ACCOUNT_MANAGER") and r[5] is None] or [0]
        times = [m for s, m in tat if s == study] or [missing]
        for block in blocks:
            seen = want.setdefault(client, {}).setdefault(block, {})
            for number in hits:
                for minutes in times:
                    cell = seen.setdefault(name, [0, 0, 0])
                    cell[0] += 1
                    cell[1] += minutes is not None and name in MODALITY_SLA and minutes <= MODALITY_SLA[name]
                    cell[2] += number != 0
    rows = []
    for client, blocks in want.items():
        if "total" in blocks:
            flat = [client]
            for block in ("total", "recent"):
                for name in MODALITY_SLA:
                    flat += blocks.get(block, {}).get(name, [0, 0, 0])
            rows.append(tuple(flat))
    return sorted(rows)


def columns(prefix="Last_30_", with_rework=True):
    out = []
    for p in ("", prefix):
        for name in MODALITY_SLA:
            out += [f"{p}{name}_Count", f"{p}Within_TAT_{name}"] + ([f"{p}{name}_Rework"] if with_rework else [])
    return out


def sample(seed):
    rng = random.Random(seed)
    names = [*MODALITY_SLA, "OTHER"]
    studies = [
        (i, rng.choice([1, 1, 1, 2, 3]), ts(AS_OF - dt.timedelta(days=rng.randint(0, 60))),
         rng.choice(["COMPLETED", "OPEN"]), rules(rng.choice(names)))
        for i in range(1, 150)
    ]
    reworks = [
        rework(rng.randint(0, 3), rng.randint(1, 150), rng.choice(["CLIENT", "ACCOUNT_MANAGER", "STAFF"]),
               rng.choice(["COMPLETED", "OPEN"]), rng.choice([None, None, 4]))
        for _ in range(150)
    ]
    tat = [(rng.randint(1, 150), rng.choice([None, 30.0, 60.0, 100.0, 150.0, 180.0, 181.0])) for _ in range(200)]
    return studies, reworks, tat


@pytest.mark.parametrize("seed", [1, 2])
def test_products_of_per_study_sums_equal_the_joined_rows(make, seed):
    studies, reworks, tat = sample(seed)
    got = make(studies, reworks, tat)
    want = brute(studies, reworks, tat, lambda day: day >= AS_OF - dt.timedelta(days=30))
    assert rows_of(got, "client_fk", *columns()) == want


def test_month_block(make):
    studies, _, tat = sample(3)
    got = make(studies, tat=tat, month=True)
    want = brute(studies, [], tat, lambda day: day >= AS_OF.replace(day=1))
    keep = [0] + [i for i in range(1, 25) if i % 3]
    assert rows_of(got, "client_id", *columns("Current_", False)) == [tuple(row[i] for i in keep) for row in want]


def test_missing_time_can_be_excluded(make):
    studies = [(1, 1, ts(AS_OF), "COMPLETED", rules("CT"))]
    assert rows_of(make(studies), "CT_Count", "Within_TAT_CT") == [(1, 1)]
    assert rows_of(make(studies, missing_tat="exclude"), "CT_Count", "Within_TAT_CT") == [(1, 0)]


def test_reworks_multiply_cases_unless_studies_are_distinct(make):
    studies = [(1, 1, ts(AS_OF), "COMPLETED", rules("CT"))]
    reworks, tat = [rework(5, 1), rework(6, 1)], [(1, 30.0), (1, 500.0)]
    names = ("CT_Count", "Within_TAT_CT", "CT_Rework")
    assert rows_of(make(studies, reworks, tat), *names) == [(4, 2, 4)]
    assert rows_of(make(studies, reworks, tat, distinct_studies=True), *names) == [(1, 1, 2)]


def test_recent_block_takes_any_status_unless_told_otherwise(make):
    studies = [(1, 1, ts(AS_OF), "COMPLETED", rules("CT")), (2, 1, ts(AS_OF), "OPEN", rules("CT"))]
    names = ("CT_Count", "Last_30_CT_Count")
    assert rows_of(make(studies), *names) == [(1, 2)]
    assert rows_of(make(studies, completed_only_recent=True), *names) == [(1, 1)]


def test_recent_bound_is_inclusive(make):
    day = AS_OF - dt.timedelta(days=30)
    studies = [(1, 1, ts(day), "COMPLETED", rules("NM")), (2, 1, ts(day - dt.timedelta(days=1)), "COMPLETED", rules("NM"))]
    assert rows_of(make(studies), "NM_Count", "Last_30_NM_Count") == [(2, 1)]
    assert rows_of(make(studies, recent_days=31), "Last_30_NM_Count") == [(2,)]


def test_clients_need_a_completed_study_of_any_modality(make):
    studies = [
        (1, 1, ts(AS_OF), "COMPLETED", rules("OTHER")),
        (2, 2, ts(AS_OF), "OPEN", rules("CT")),
        (3, 3, ts(AS_OF), "COMPLETED", rules("CT")),
        (4, None, ts(AS_OF), "COMPLETED", rules("CT")),
        (5, 4, ts(AS_OF), "COMPLETED", rules("CT")),
    ]
    got = make(studies, clients=[(1, "one"), (2, "two")], exclude=[4])
    assert rows_of(got, "client_fk", "client_name", "CT_Count") == [(1, "one", 0), (3, "", 1)]


def test_targets_are_a_parameter(make):
    studies = [(1, 1, ts(AS_OF), "COMPLETED", rules("NM"))]
    got = make(studies, tat=[(1, 200.0)], sla={"NM": 240, "CT": 120})
    assert rows_of(got, "NM_Count", "Within_TAT_NM", "CT_Count") == [(1, 1, 0)]
    assert "XRAY_Count" not in got.columns
