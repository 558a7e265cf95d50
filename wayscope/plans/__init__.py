"""Whole audits as plans over the operators."""

from .document import audit_documents, delta_documents, metrics, to_json_rows, track_metrics, write_json
from .prevalence import prevalence
from .report import held, report, statuses

__all__ = ["audit_documents", "delta_documents", "held", "metrics", "prevalence", "report", "statuses", "to_json_rows", "track_metrics", "write_json"]
