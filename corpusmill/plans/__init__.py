"""Control plans and the queries that put operators together."""
