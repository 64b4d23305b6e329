"""Forecasting."""
