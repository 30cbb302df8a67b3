"""streaming of helixframe."""
