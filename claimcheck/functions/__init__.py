"""Column expressions: no UDFs, every one stays inside the JVM."""
