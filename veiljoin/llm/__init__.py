"""Training-data operators: one module an operator, each a function from DataFrames to a DataFrame.

Nothing outside this subpackage imports it. Intermediate tables go to the shared folder
that ``spark.checkpoint.dir`` names (see ``common.shared_dir``).
"""
