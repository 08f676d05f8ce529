"""Column-expression functions: everything stays inside JVM code generation."""
