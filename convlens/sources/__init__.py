"""Scans, sinks and inspection of activity logs."""
