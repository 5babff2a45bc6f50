"""loomgraph: linked-data and text-corpus analytics on plain PySpark."""
