"""Part of tessarine."""
