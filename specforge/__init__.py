"""Document-conformity analytics on Spark: DataFrame operators, readers, plans and streams."""
