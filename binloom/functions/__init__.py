"""Column functions: every one returns a Column and stays on the JVM unless stated."""
