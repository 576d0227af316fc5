"""Column-expression helpers and small reusable DataFrame patterns."""
