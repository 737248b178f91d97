"""Longitudinal registry analytics on Spark: cleaning, derivation, description, survival."""
