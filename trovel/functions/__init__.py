"""Part of trovel."""
