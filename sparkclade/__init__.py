"""sparkclade: phylogenetic and comparative-sequence analytics on Spark DataFrames."""
