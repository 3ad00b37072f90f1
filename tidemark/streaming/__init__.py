"""Comparison of tables that change."""
