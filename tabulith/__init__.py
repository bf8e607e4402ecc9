"""Scientific-results extraction, linking and evaluation as Spark DataFrame operators."""
