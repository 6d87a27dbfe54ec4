"""Delivery and state semantics as streams."""
