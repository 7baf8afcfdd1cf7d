"""Task-aware data quality on Spark DataFrames: type, profile, detect, repair, grade and calibrate tables of any size."""
