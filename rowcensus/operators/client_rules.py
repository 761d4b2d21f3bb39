"""The rules shipped for a client book with an adviser register."""

from __future__ import annotations

from ..functions import labels
from .builders import Reference, any_valid_reference, required_reference, retention_cutoff, status_measure
from .rules import Rule

# Ids, names, severities and issue texts as they appear in reports.
CLIENT_RULES: tuple[Rule, ...] = (
    status_measure(
        id="archived_client_with_aum",
        name="Archived clients still showing AUM",
        description="An archived client holds no assets any more",
        severity="high",
        table="CLIENTS",
        primary_key=("CLIENT_ID",),
        status="CLIENT_STATUS",
        value="ARCHIVED",
        measure="AUM",
        detail="Client is archived but AUM = ",
    ),
    retention_cutoff(
        id="pre_2017_client_not_deleted",
        name="Clients listed prior to 2017 should be deleted",
        description="Records from before 2017 are past their retention period",
        severity="high",
        table="CLIENTS",
        primary_key=("CLIENT_ID",),
        created="CREATED_DATE",
        cutoff="2017-01-01",
        deleted="IS_DELETED",
        before="Client created ",
        after=" but still present",
        payload=("CREATED_DATE", "CLIENT_STATUS"),
    ),
    any_valid_reference(
        id="invalid_im_fp",
        name="Clients missing or with invalid IM / FP adviser",
        description="One of the two adviser codes is set, and each that is set is in the register",
        severity="medium",
        table="CLIENTS",
        primary_key=("CLIENT_ID",),
        refs=(
            Reference("IM_CODE", "ADVISERS", "ADVISER_CODE", "ADVISER_ID", "Invalid IM code: "),
            Reference("FP_CODE", "ADVISERS", "ADVISER_CODE", "ADVISER_ID", "Invalid FP code: "),
        ),
        missing="Missing IM and FP — at least one adviser required",
        deleted="IS_DELETED",
    ),
    required_reference(
        id="invalid_rm",
        name="Clients missing or with invalid Relationship Manager (RM)",
        description="The relationship manager's code is set and in the register",
        severity="medium",
        table="CLIENTS",
        primary_key=("CLIENT_ID",),
        ref=Reference("RM_CODE", "ADVISERS", "ADVISER_CODE", "ADVISER_ID", "Invalid RM code: "),
        missing="Missing RM code — Relationship Manager required",
        deleted="IS_DELETED",
    ),
    Rule(
        id=labels.DUPLICATE_TYPE,
        name=labels.DUPLICATE_RULE,
        description="The profiler found a key more than once",
        severity=labels.DUPLICATE_SEVERITY,
        dynamic=True,
    ),
    Rule(
        id=labels.HIGH_NULL_TYPE,
        name=labels.HIGH_NULL_RULE,
        description="The profiler found more nulls than the threshold allows",
        severity=labels.HIGH_NULL_SEVERITY,
        dynamic=True,
    ),
)
