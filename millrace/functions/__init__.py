"""Column functions: text, evidence patterns and vectors. All are built-in expressions, evaluated in the JVM."""
