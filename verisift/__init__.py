"""verisift: truth discovery and on-demand fusion over conflicting sources, on Spark DataFrames."""
