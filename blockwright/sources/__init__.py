"""Reading and writing of containers."""
