"""strandloom: DNA-methylation analytics on Spark DataFrames."""
