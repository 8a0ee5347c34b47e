"""Program reachability and triage on Spark DataFrames."""
