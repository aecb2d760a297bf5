"""folioscan: document auditing and text preparation as Spark DataFrame plans."""
