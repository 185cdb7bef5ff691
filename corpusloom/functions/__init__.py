"""Column expressions: Column in, Column out, evaluated inside the JVM."""
