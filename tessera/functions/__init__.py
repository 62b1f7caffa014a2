"""Scalar functions as native expressions."""
