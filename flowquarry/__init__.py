"""Flow analytics on Spark: cleaning, profiling, scoring, explaining and routing of
network-flow records as plain ``DataFrame -> DataFrame`` functions."""
