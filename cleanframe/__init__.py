"""cleanframe: profiling, cleaning and preparing tables with Spark."""
