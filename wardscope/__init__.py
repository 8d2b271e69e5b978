"""Regional service-capacity analytics as DataFrame-to-DataFrame functions on Spark."""
