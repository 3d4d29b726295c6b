"""Column functions: distances, time bins, radio physics and text similarity. All run inside the JVM."""
