"""packlens: label-compliance analytics expressed as Spark DataFrame transformations."""
