"""Code-review analytics over tables of source files, on Spark."""
