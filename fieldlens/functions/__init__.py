"""Operators by kind; see the README."""
