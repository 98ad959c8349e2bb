"""rasterlake: raster frames, their annotations and their texts as Spark tables."""
