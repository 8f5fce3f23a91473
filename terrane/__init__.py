"""terrane: regional and geospatial attribute analytics on Spark DataFrames."""
