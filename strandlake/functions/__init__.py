"""Column functions; all stay inside the JVM."""
