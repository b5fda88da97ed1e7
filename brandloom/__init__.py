"""Site brand analytics as Spark jobs: DataFrame in, DataFrame out."""
