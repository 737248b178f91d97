"""DataFrame operators: quality checks, longitudinal repair, description, survival."""
