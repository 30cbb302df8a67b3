"""kernels of helixframe."""
