"""Messages to send, as rows of an outbox table. Delivery is not part of this library."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casepulse.functions import payload, text
from casepulse.functions.numbers import format_pct, guarded_pct
from casepulse.operators.keyed import column_or_default
from casepulse.schemas import MAIL_TAT_LABELS, MESSAGE_TAT_LABELS


def _recent(rows: DataFrame, modality: str) -> tuple[Column, Column, Column]:
    """Recent cases, cases within target and reworks; 0 where a client has none."""
    names = (f"{modality}_Count", f"Within_TAT_{modality}", f"{modality}_Rework")
    found = [column_or_default(rows, f"Last_30_{name}") for name in names]
    cases, within, rework = (F.coalesce(value, F.lit(0)).cast("long") for value in found)
    return cases, within, rework


def message_params(rows: DataFrame, labels: Mapping[str, str] = MESSAGE_TAT_LABELS) -> Column:
    """Six texts per modality (target, cases, within, within %, reworks, rework %), then the id."""
    params = []
    for modality, label in labels.items():
        cases, within, rework = _recent(rows, modality)
        params += [
            F.lit(label),
            cases,
            within,
            format_pct(guarded_pct(within, cases)),
            rework,
            format_pct(guarded_pct(rework, cases)),
        ]
    return F.array(*[value.cast("string") for value in (*params, F.col("created_id"))])


def message_outbox(
    rows: DataFrame,
    *,
    template_id: str,
    source: str,
    sender: str,
    channel: str = "whatsapp",
    labels: Mapping[str, str] = MESSAGE_TAT_LABELS,
    only_triggered: bool = False,
    link_base: str | None = None,
) -> DataFrame:
    """One message per survey row that has a phone.

    A phone that is not ten digits is flagged but keeps its message. ``link_base`` adds the
    feedback link as a column.
    """
    if only_triggered:
        rows = rows.filter("trigger")
    reachable = rows.filter(F.col("phone_number").isNotNull())
    built = reachable.withColumns(
        {
            "destination": text.clean_phone(F.col("phone_number")),
            "phone_valid": text.is_local_phone(text.strip_country_code(F.col("phone_number"))),
            "params": message_params(reachable, labels),
        }
    ).withColumn("template", payload.template_json(template_id, F.col("params")))
    body = payload.form_encode(
        [
            ("channel", F.lit(channel)),
            ("source", F.lit(source)),
            ("destination", F.col("destination")),
            ("src.name", F.lit(sender)),
            ("template", F.col("template")),
        ]
    )
    out = built.select(
        "created_id", "client_fk", "contact_fk", "trigger", "destination", "phone_valid",
        "params", "template", body.alias("body"),
    )
    if link_base is None:
        return out
    return out.withColumn("feedback_link", payload.feedback_link(link_base, F.col("created_id")))


def modality_payload(
    rows: DataFrame, *, labels: Mapping[str, str] = MAIL_TAT_LABELS
) -> DataFrame:
    """Rows with an e-mail and, as an array, the modalities they had recent cases in.

    ``percentage`` is not rounded. Rows whose array is empty need no mail and are left out.
    """
    entries = []
    for modality, label in labels.items():
        cases, within, rework = _recent(rows, modality)
        entries.append(
            F.struct(
                F.lit(modality).alias("modality"),
                cases.alias("total"),
                F.lit(label).alias("avg_tat"),
                within.alias("delivered_within_tat"),
                guarded_pct(within, cases).alias("percentage"),
                rework.alias("rework"),
            )
        )
    used = F.filter(F.array(*entries), lambda entry: entry["total"] > 0)
    return (
        rows.filter(text.has_text(F.col("email")))
        .select(
            "created_id", "client_fk", "contact_fk", "Client_Name", "email",
            used.alias("modality_data"),
        )
        .filter(F.size("modality_data") > 0)
    )


def mail_recipients(mails: DataFrame, cc: Column) -> DataFrame:
    """Mails with their recipient list; ``cc`` is an array of addresses."""
    return mails.withColumn("recipients", payload.recipients(F.array("email"), cc))


def delivery_status(log: DataFrame) -> DataFrame:
    """Status and result code of each answer in a delivery log with a ``response`` column."""
    answered = log.withColumn("status", payload.response_status(F.col("response")))
    return answered.withColumn("status_code", payload.status_code(F.col("status")))
