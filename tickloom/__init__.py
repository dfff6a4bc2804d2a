"""tickloom: market-data and options analytics as DataFrame-to-DataFrame functions on Spark."""
