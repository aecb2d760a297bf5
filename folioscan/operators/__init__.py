"""Operators on documents: rules, scans, edits, citations."""
