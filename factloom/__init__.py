"""Graph-pattern analytics over entity–attribute–value facts, compiled to Spark DataFrames."""
