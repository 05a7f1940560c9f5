"""folioflow: dataflow over pages, paragraphs, replies and edits, on PySpark."""
