"""Registered queries, a module for each family of operators."""
