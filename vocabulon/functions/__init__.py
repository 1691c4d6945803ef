"""Part of vocabulon; see the README."""
