"""Scalar rules as column expressions, and driver-side helpers."""
