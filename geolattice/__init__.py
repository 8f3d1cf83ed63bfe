"""Point analytics on ordinary DataFrames: geohash keys, containment, nearest neighbours, top-k."""
