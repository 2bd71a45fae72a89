"""framelake: frame, detection and event analytics as lazy Spark DataFrame transforms."""
