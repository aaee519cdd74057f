"""sources of the assurance engine."""
