"""Operators over rows: routing, splitting, archiving, copying, reports and invariants."""
