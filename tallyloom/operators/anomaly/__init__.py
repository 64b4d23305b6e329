"""Anomaly detection."""
