"""Column functions built from JVM-side expressions."""
