"""Column builders: expressions that stay inside one generated stage."""
