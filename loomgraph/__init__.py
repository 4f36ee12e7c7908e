"""Code-graph analytics on Spark: index tables, queries, event queue and text-corpus operators."""
