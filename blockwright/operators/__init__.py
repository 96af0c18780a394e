"""DataFrame operators: blocks, search, frames, statistics."""
