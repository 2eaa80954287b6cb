"""The views that every engine has: grants, assignments, wedged queues and held keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from fathomlog.functions.coordinates import not_received_from_own_identity
from fathomlog.plans.specs import (
    AggregateId, Combined, Composite, ConstantFields, EventTimestamp, Interest, ListedKeys, ListLength, SelectedFields, TableView, WholePayload,
)


def _not_its_own_echo(log: DataFrame) -> Column:
    return not_received_from_own_identity()


# Names of views, event types and fields.
GRANTS = TableView(
    "role_permission_grants",
    Interest(event_types=frozenset({"permission_granted", "permission_revoked"}), aggregate_types=frozenset({"role_permission_grant"})),
    frozenset({"permission_granted"}), frozenset({"permission_revoked"}), AggregateId(), WholePayload(),
)
ASSIGNMENTS = TableView(
    "user_role_scopes",
    Interest(event_types=frozenset({"role_assigned", "role_unassigned"}), aggregate_types=frozenset({"user_role_scope"})),
    frozenset({"role_assigned"}), frozenset({"role_unassigned"}), AggregateId(), WholePayload(),
)


def wedges(entry_types: frozenset[str], aggregate_type: str) -> TableView:
    """Queues that are wedged; rows go when the queue recovers or is deleted."""
    fields = (
        "id database_id row_id event_ids first_seq last_seq sequence_in_queue cause attempt_count max_attempts max_retry_ms last_outcome http_status "
        "wire_format transform_version halt_request_event_id halt_requested_by halt_purpose drainer_epoch configuration_fingerprint configuration"
    )
    events = frozenset({"destination_wedged", "destination_wedge_recovered", "destination_deleted"})
    return TableView(
        "default_destination_wedges", Interest(entry_types, events, frozenset({aggregate_type}), True, _not_its_own_echo),
        frozenset({"destination_wedged"}), frozenset({"destination_wedge_recovered", "destination_deleted"}),
        Composite(("data.database_id", "data.id")), SelectedFields(tuple(fields.split())),
    )


def holds(entry_types: frozenset[str], aggregate_type: str) -> TableView:
    """Keys on hold; a release marks the row of its own hold, and deleting a destination clears the keys that it lists."""
    events = frozenset({"destination_held", "destination_hold_released", "destination_hold_cleared", "destination_deleted"})
    data = Combined((
        SelectedFields(tuple("id database_id key hold_id row_id failed_event_id cause attempt_count".split())),
        ListLength("event_count", "event_ids"), EventTimestamp("held_at"), ConstantFields((("state", "held"),)),
    ))
    return TableView(
        "default_destination_holds", Interest(entry_types, events, frozenset({aggregate_type}), True, _not_its_own_echo),
        frozenset({"destination_held"}), frozenset({"destination_hold_cleared"}), Composite(("data.database_id", "data.id", "data.key")), data,
        updates=frozenset({"destination_hold_released"}), update_data=ConstantFields((("state", "releasing"),)), match_field="hold_id",
        listed=ListedKeys(frozenset({"destination_deleted"}), "key_lists", ("data.database_id", "data.id", "item.key")),
    )
