"""textshield: document privacy and clean-up on Spark DataFrames."""
