"""Evidence-table analytics on Spark: DataFrame operators, readers and writers."""
