"""Location analytics on Spark: road travel times, places and street assets."""
