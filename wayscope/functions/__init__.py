"""Column expressions: numbers and times as text, distances, guards."""

from .geo import finite, haversine
from .parsing import clock, epoch_ms, fixed, js_number, parse_float, trimmed

__all__ = ["clock", "epoch_ms", "finite", "fixed", "haversine", "js_number", "parse_float", "trimmed"]
