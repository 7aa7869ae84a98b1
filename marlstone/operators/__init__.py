"""Operators; import the module you need."""
