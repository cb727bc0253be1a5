"""Column -> Column building blocks. Everything here stays in the JVM."""
