"""Column functions: everything stays in the JVM."""
