"""Relational building blocks of the comparison."""
