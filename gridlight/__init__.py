"""gridlight: image and table analytics on Spark DataFrames."""
