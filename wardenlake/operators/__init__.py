"""operators of the assurance engine."""
