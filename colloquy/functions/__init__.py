"""Part of colloquy; see README."""
