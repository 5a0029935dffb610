"""Dataset transforms: DataFrame in, DataFrame out."""
