"""Contact directory, and the contacts of churned clients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casepulse.functions import text
from casepulse.operators.keyed import (
    distinct_keys,
    join_hot,
    left_join_hot,
    only_keys,
    without_ids,
)
from casepulse.schemas import DIRECTORY_EXCLUDED, MODALITY_SLA

DIRECTORY_COLUMNS = (
    "client_fk", "contact_fk", "unique_id", "client_name", "phone_number", "email",
    "designation", "persona_type",
)


def contact_directory(
    clients: DataFrame,
    contacts: DataFrame,
    *,
    exclude: Sequence[int] | DataFrame | None = DIRECTORY_EXCLUDED,
    only: DataFrame | None = None,
) -> DataFrame:
    """Contacts of each client, plus the account itself as contact 0.

    A client without contacts is listed with contact 0 and empty, not missing, fields besides
    the account row. Duplicate rows are removed on each side before the join, which gives the
    same rows as removing them afterwards and leaves a client that owns a large share of the
    contacts spread over many tasks. ``only`` (column client_fk) cuts both tables to those clients
    first.
    """
    if only is not None:
        clients = only_keys(clients, only, "id", "client_fk")
        contacts = only_keys(contacts, only, "client_fk")
    kept = without_ids(clients, "id", exclude).select(
        F.col("id").alias("client_fk"), "unique_id", "client_name", "email"
    )
    named = kept.select("client_fk", "unique_id", "client_name").distinct()
    people = contacts.select(
        F.col("id").alias("contact_fk"),
        "client_fk",
        text.null_na(F.col("phone")).alias("phone_number"),
        "email",
        text.strip_list_marks(F.col("designation")).alias("designation"),
        "persona_type",
    ).distinct()
    listed = join_hot(named, people, ["client_fk"], ["contact_fk"], sizes=contacts)
    no_contact = F.lit(0).cast("long")
    empty = {name: F.lit("") for name in ("phone_number", "email", "designation", "persona_type")}
    lonely = named.join(
        distinct_keys(contacts, "client_fk"), "client_fk", "left_anti"
    ).withColumns({"contact_fk": no_contact, **empty})
    missing = {
        name: F.lit(None).cast("string") for name in ("phone_number", "designation", "persona_type")
    }
    accounts = kept.distinct().withColumns({"contact_fk": no_contact, **missing})
    parts = [part.select(*DIRECTORY_COLUMNS) for part in (listed, lonely, accounts)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


RECENT_COUNTS = tuple(
    f"Last_30_{part}"
    for name in MODALITY_SLA
    for part in (f"{name}_Count", f"Within_TAT_{name}", f"{name}_Rework")
)


def _with_modality(churn: DataFrame, modality: DataFrame) -> DataFrame:
    """Churned clients with their recent counts; both sides hold one row per client."""
    return churn.join(modality.select("client_fk", *RECENT_COUNTS), "client_fk", "left")


def _report_columns(listed: DataFrame) -> DataFrame:
    return listed.select(
        "client_fk",
        F.col("churn_category").alias("churn_type"),
        "active_days",
        "avg_case_load",
        "client_active_type",
        "contact_fk",
        "unique_id",
        F.col("client_name").alias("Client_Name"),
        text.null_na(F.col("phone_number")).alias("phone_number"),
        "email",
        *RECENT_COUNTS,
    )


def churn_contacts(
    churn: DataFrame, contacts: DataFrame, modality: DataFrame, sizes: DataFrame | None = None
) -> DataFrame:
    """Churned clients with each of their contacts and their recent modality counts.

    Clients that the directory does not hold stay, without a contact. ``sizes`` (column client_fk) may
    tell the clients with many contacts in place of the directory.
    """
    people = contacts.drop("designation", "persona_type")
    return _report_columns(
        left_join_hot(_with_modality(churn, modality), people, ["client_fk"], ["contact_fk"], sizes=sizes)
    )


def reachable_contacts(
    churn: DataFrame, contacts: DataFrame, modality: DataFrame, sizes: DataFrame | None = None
) -> DataFrame:
    """The contacts above that have a phone or an e-mail.

    A client without any contact cannot be reached, so this needs no outer join and the
    contact filter runs at the scan.
    """
    people = contacts.drop("designation", "persona_type").filter(
        text.has_text(text.null_na(F.col("phone_number"))) | text.has_text(F.col("email"))
    )
    return _report_columns(
        join_hot(_with_modality(churn, modality), people, ["client_fk"], ["contact_fk"], sizes=sizes)
    )
