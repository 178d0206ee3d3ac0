"""Whole workflows composed of the table operators."""
