"""Package-evidence analytics expressed as Spark DataFrame transformations."""
