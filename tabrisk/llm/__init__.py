"""Training-data operators: ten stand-alone Spark jobs over text, pages and
embeddings.  Nothing else in the library imports this subpackage."""
