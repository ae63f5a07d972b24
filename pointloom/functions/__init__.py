"""Part of pointloom; see README.md."""
