"""Where points come from: GPX documents, tables, generators."""

from .files import register, split_points, write_documents, write_gpx_files
from .gpx import found_points, malformed_files, read_gpx
from .synthetic import linear_track, to_gpx
from .tables import event_points, order_points
from .walk import seeded_walk

__all__ = ["event_points", "found_points", "linear_track", "malformed_files", "order_points", "read_gpx", "register", "seeded_walk", "split_points", "to_gpx", "write_documents", "write_gpx_files"]
