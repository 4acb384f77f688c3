"""Document translation dataflow on PySpark."""
