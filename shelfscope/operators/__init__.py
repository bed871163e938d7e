"""General operators: ordered and ranked results, relational helpers, nearest neighbours."""
