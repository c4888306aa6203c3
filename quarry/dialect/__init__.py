"""The SQL dialect: tokens, rewrites towards Spark SQL, statements, options."""
