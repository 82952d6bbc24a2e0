"""Operators of a training-data pipeline, each over whole tables of documents,
pages or embeddings.  Nothing else in the library imports this subpackage."""
