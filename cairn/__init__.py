"""Quality evaluation of 3D data and preparation of text corpora as Spark jobs."""
