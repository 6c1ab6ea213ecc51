"""Logical plans: the well view of the tables, and the registered queries."""
