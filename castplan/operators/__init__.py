"""Planning operators: DataFrame in, DataFrame out."""
