"""downfield: play-by-play analytics as Spark DataFrame transformations."""
