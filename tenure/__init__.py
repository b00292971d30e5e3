"""Lifecycle analytics for leased work items, written as Spark DataFrame operators."""
