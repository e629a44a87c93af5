"""Line-versus-outcome analytics expressed as Spark DataFrame plans."""
