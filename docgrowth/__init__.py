"""docgrowth: growth and document analytics as Spark DataFrame operators."""
