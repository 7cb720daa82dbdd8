"""Building blocks: DataFrame in, DataFrame out, nothing collected."""
