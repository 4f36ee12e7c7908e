"""Column functions: paths, ranges, imports, scores, parameters.  No UDFs."""
