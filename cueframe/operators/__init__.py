"""Operators over segment tables keyed by track_id."""
