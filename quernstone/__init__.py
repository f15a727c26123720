"""Point-in-time issuer research operators on PySpark DataFrames."""
