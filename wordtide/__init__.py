"""wordtide: word usage across corpora and over time, on Spark DataFrames."""
