"""orogen: spatial, raster and borehole analytics as Spark DataFrame jobs."""
