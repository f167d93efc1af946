"""Typed flows of operators."""
