"""Column functions: every function takes and returns ``Column`` and stays in generated JVM code."""
