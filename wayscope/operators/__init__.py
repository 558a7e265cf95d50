"""Audit operators: tables of points in, tables of findings out."""
