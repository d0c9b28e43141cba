"""Bindings of tables, and fixtures."""
