"""Operators on bitemporal tables: mutations, comparison, verified copies, decision tables, navigation."""
