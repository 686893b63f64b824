"""Population-genomics and corpus jobs written as plain Spark DataFrame programs."""
