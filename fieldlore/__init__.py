"""fieldlore: structure inference for binary messages, and corpus operators, on Spark DataFrames."""
