"""Fixed values of the reconciliation rules."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    auto_match: float = 0.90
    audit_rate: float = 0.10
    split_coverage: float = 0.85
    split_overlap: float = 0.10
    area_tolerance: float = 0.15
    radius_k: float = 3.0
    radius_min: float = 1.0
    sigma: float = 0.25
    registration_sigma: float = 0.30
    clear_p: float = 0.70
    clear_margin: float = 0.08
    high_p: float = 0.60
    no_match_p: float = 0.45
    merge_p: float = 0.85
    child_share: float = 0.5
    gnss_radius: float = 1.0
    temporal: float = 0.9
    revenue_difference: float = 0.15
    overlap_share: float = 0.05


RULES = Rules()
WEIGHTS = {"survey": 6, "geometry": 5, "physical": 4, "identity": 3, "attribute": 2, "temporal": 1}
TRANSITIONS = {
    "OBSERVED": ("CANDIDATE",), "CANDIDATE": ("VALIDATED", "REJECTED", "FIELD_VERIFICATION"), "VALIDATED": ("APPROVED", "REJECTED", "FIELD_VERIFICATION"),
    "FIELD_VERIFICATION": ("CANDIDATE", "VALIDATED", "REJECTED"), "APPROVED": ("PUBLISHED", "SUPERSEDED"), "PUBLISHED": ("SUPERSEDED",),
}
