"""Compositions of operators: scoring, evidence, reports."""
