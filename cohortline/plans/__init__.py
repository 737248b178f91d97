"""Configurations of the operators: the myeloma registry, and the driver tables as encounters."""
