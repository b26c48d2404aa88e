"""Column expressions shared by the operators; all of them stay on the JVM side."""
