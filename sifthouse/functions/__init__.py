"""Functions of the engine, as functions over DataFrames and Columns."""
