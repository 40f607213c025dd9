"""Message bodies, recipients and delivery answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Answers that count as accepted, and the two result codes.
ACCEPTED = ("queued", "sent")
STATUS_ACCEPTED, STATUS_FAILED = 202, 500

# Texts used when an answer holds no status.
NO_STATUS = "No status in response"
NOT_JSON = "Error: Unable to parse response as JSON"


def feedback_link(base: str, created_id: Column) -> Column:
    return F.concat(F.lit(base), created_id.cast("string"))


def template_json(template_id: str, params: Column) -> Column:
    return F.to_json(F.struct(F.lit(template_id).alias("id"), params.alias("params")))


def form_encode(fields: Sequence[tuple[str, Column]]) -> Column:
    """application/x-www-form-urlencoded text of the fields, in order."""
    pairs = [F.concat(F.lit(name + "="), F.url_encode(value)) for name, value in fields]
    return F.concat_ws("&", *pairs)


def recipients(to: Column, cc: Column) -> Column:
    """to and cc in one list, each entry tagged; an address in both lists is tagged 'to'."""
    return F.transform(
        F.concat(to, cc),
        lambda email: F.struct(
            email.alias("email"),
            F.when(F.array_contains(to, email), "to").otherwise("cc").alias("type"),
        ),
    )


def response_status(response: Column) -> Column:
    """``status`` of a JSON answer, or a text that says why there is none."""
    is_json = F.try_parse_json(response).isNotNull()
    status = F.coalesce(F.get_json_object(response, "$.status"), F.lit(NO_STATUS))
    return F.when(is_json, status).otherwise(F.lit(NOT_JSON))


def status_code(status: Column) -> Column:
    return F.when(status.isin(*ACCEPTED), STATUS_ACCEPTED).otherwise(STATUS_FAILED)
