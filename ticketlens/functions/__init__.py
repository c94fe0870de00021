"""Column expressions: built-in Spark functions only (JVM side, codegen)."""
