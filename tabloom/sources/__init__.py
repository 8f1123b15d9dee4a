"""Reading and writing datasets, shared working storage and the registry."""
