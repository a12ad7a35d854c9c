"""Column functions over candidate values; all of them stay inside the JVM."""
