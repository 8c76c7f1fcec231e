"""Reading and writing self-describing buffers."""
