"""Panel operators: DataFrame in, DataFrame out, partitioned by ``keys``."""
