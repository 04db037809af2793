"""Steps that need a running state over a document: Arrow-batched Python functions."""
