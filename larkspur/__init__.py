"""larkspur: a strict SQL table engine and data toolkit that runs on Spark."""
