"""prooflake: claim analysis over document corpora on Spark DataFrames."""
