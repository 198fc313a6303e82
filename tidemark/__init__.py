"""Token-usage analytics on Spark: DataFrame in, DataFrame out."""
