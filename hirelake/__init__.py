"""Job-posting analytics as Spark DataFrame transformations."""
