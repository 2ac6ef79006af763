"""Document-audit analytics for PySpark: DataFrame in, DataFrame out."""
