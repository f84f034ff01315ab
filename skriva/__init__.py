"""skriva: transcript analytics on PySpark (see README.md)."""
