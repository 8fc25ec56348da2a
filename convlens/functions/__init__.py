"""Column expressions (JVM-side, codegen'd) and small scalar helpers."""
