"""keelstone: keyed lakehouse tables and large-scale data processing, built on PySpark."""
