"""Distributed operators over long tables of series."""
