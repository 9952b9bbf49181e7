"""Column helpers: JVM expressions only, no Python UDFs."""
