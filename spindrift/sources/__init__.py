"""Where documents, settings and stored generations come from."""
