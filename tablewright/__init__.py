"""Table-question corpora on Spark: answer, describe, convert and score them with DataFrames."""
