"""Template-consistency analytics on PySpark."""
