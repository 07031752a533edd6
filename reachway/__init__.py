"""Population access to facilities over road networks, on PySpark."""
