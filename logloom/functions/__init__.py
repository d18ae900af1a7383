"""Column functions, all on the JVM side."""
