"""Era-panel evaluation on Spark: DataFrame in, DataFrame out."""
