"""Column expressions.  Every function maps Columns to a Column and stays in the JVM."""
