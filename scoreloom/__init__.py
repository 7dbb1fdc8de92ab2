"""Scorecard-style preparation and modelling of large binary-target tables on PySpark."""
