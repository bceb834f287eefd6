"""Near-duplicate analytics on Spark: signatures, similarity joins, clusters, keepers."""
