"""The stateless steps over streams."""
