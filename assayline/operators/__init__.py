"""Operators over series, panels, stores, blood pressure, names and report lines."""
