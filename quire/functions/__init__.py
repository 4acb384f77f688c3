"""Column functions; every one is a JVM expression."""
