"""Analytics over photo and video catalogs as lazy Spark DataFrames."""
