"""Set-at-a-time retrieval, audit and evaluation operators on PySpark DataFrames."""
