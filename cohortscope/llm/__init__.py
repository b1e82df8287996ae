"""Training-data operators: ten corpus operators, each a Spark job over DataFrames."""
