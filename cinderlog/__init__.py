"""A structured-log analytics engine expressed with the public PySpark APIs."""
