"""Fleet operators: DataFrame in, DataFrame out."""
