"""Forecasting models over all series at once."""
